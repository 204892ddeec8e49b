"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from caselight.llm.decontamination import op7_decontamination
from caselight.llm.extraction import op4_html_extraction
from caselight.llm.neighbours import op11_learned_partitions
from caselight.llm.ngram_join import op1_ngram_jaccard_join
from caselight.llm.packing import op2_packing
from caselight.llm.passages import op5_repeated_passages
from caselight.llm.prefix_trie import op12_prefix_trie, prefix_trie_sql
from caselight.llm.quality import op8_quality_rules
from caselight.llm.secret_sql import secret_scan_sql
from caselight.llm.secrets import op3_secret_scan
from caselight.llm.sharding import op10_rendezvous_shards
from caselight.llm.source_audit import op13_source_audit, source_audit_sql
from caselight.llm.token_counts import op6_token_counts
from caselight.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_packing": op2_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_rendezvous_shards": op10_rendezvous_shards,
    "op11_learned_partitions": op11_learned_partitions,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_audit": op13_source_audit,
}

#: The other queries hash, tokenize, align or learn, which SQL can't express: tests/llm holds plain versions.
SQL: dict[str, str] = {
    "op3_secret_scan": secret_scan_sql(),
    "op12_prefix_trie": prefix_trie_sql(),
    "op13_source_audit": source_audit_sql(),
}
