"""Operator 6: token counts from the pieces of each distinct pre-token of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.shared import documents_of, settled

#: Tokens a context window holds.
LIMIT = 4096
#: Texts of a batch are split together up to this many characters.
TOGETHER = 1_000_000
#: Pre-tokens, the most frequent ones, whose counts are broadcast; the others are shuffled.
HELD = 200_000
#: Size up to which a file of the frequency table writes its pre-tokens once, as a dictionary.
DICTIONARY_BYTES = 16 << 20
#: Rows of the frequency table that are read to tell which ones these are.
SAMPLE = 4_000_000
#: Bytes of a pre-token that is its own join key; a digest stands for a longer one.
KEY_BYTES = 64

_MARK = "\x1f"
_SPACE = "▁"
_PRETOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")
_models: dict[str, object] = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def pretoken_pieces(path: str, pretokens: list[str]) -> np.ndarray:
    """Pieces of each pre-token.

    The library puts a space before any text: it stands for the first of the pre-token's own spaces, and
    before a line break it is a piece of its own, which is not counted.
    """
    ids = _model(path).encode([p[1:] if p[0] == " " else p for p in pretokens], num_threads=1)
    # a lone space is a piece, though the library adds none to an empty text
    return np.fromiter(((len(i) or 1) if p[0] == " " else len(i) - 1 for p, i in zip(pretokens, ids, strict=True)),
                       np.int64, len(pretokens))


def frequencies(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(index of the text, pre-token, how often it holds it), once for each text and distinct pre-token.

    A pre-token is a run of spaces, or a line break, with what follows up to the next space or line break.
    The model's pieces hold spaces at their beginning only and no line breaks, so none crosses a border.
    The model reads its own space mark as a space, and a text as if a space stood before it.
    """
    odd = [i for i, t in enumerate(texts) if "  " in t or t[:1] == " " or _SPACE in t or _MARK in t]
    skip = set(odd)
    plain = [i for i, t in enumerate(texts) if t and i not in skip]
    marked = pa.array([" " + texts[i] for i in plain], pa.large_string())
    for c in " \n":
        marked = pc.replace_substring(marked, c, _MARK + c)
    lists = pc.split_pattern(marked, _MARK)
    offsets = lists.offsets.to_numpy()
    # each text begins with an empty part before its first mark
    full = np.ones(len(lists.values), bool)
    full[offsets[:-1]] = False
    owners = np.repeat(np.array(plain, np.int64), np.diff(offsets))[full]
    words = lists.values.filter(pa.array(full))
    if odd:
        split = [_PRETOKEN.findall((" " + texts[i]).replace(_SPACE, " ")) for i in odd]
        owners = np.concatenate([owners, np.repeat(np.array(odd, np.int64), [len(s) for s in split])])
        words = pa.concat_arrays([words, pa.array([w for s in split for w in s], pa.large_string())])
    coded = words.dictionary_encode()
    each = max(1, len(coded.dictionary))
    held, n = np.unique(owners * each + coded.indices.to_numpy(), return_counts=True)
    return held // each, coded.dictionary.take(pa.array(held % each)), n


def spans(texts: list[str]) -> list[tuple[int, int]]:
    """Where runs of texts that are split together begin and end: ``TOGETHER`` characters each, or a little more."""
    ends = np.cumsum([len(t) for t in texts])
    parts = np.flatnonzero(np.diff(ends // TOGETHER)) + 1 if texts else []
    return list(zip([0, *parts], [*parts, len(texts)]))


def pretokens_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, word, n) for each row of ``docs`` (doc_id, text) and distinct pre-token; a null word
    and 0 for a text without any. ``row`` tells rows apart as long as this is written once."""
    kind = dict(docs.dtypes)["doc_id"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in spans(texts):
                some = texts[a:b]
                owner, words, n = frequencies(some)
                none = np.setdiff1d(np.arange(len(some)), owner)
                at = pa.array(np.concatenate([owner, none]) + a)
                sizes = pa.array([len(t.encode()) for t in some], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(at), batch.column("doc_id").take(at),
                     sizes.take(pc.subtract(at, int(a))),
                     pa.concat_arrays([words.cast(pa.string()), pa.nulls(len(none), pa.string())]),
                     pa.array(np.concatenate([n, np.zeros(len(none), np.int64)]))],
                    ["row", "doc_id", "n_bytes", "word", "n"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(split, f"row long, doc_id {kind}, n_bytes long, word string, n long")


def word_key() -> Column:
    """A pre-token's join key of bounded size; none holds two line breaks, so digests clash with no short one."""
    return F.when(F.octet_length("word") <= KEY_BYTES, F.col("word")).otherwise(
        F.concat(F.lit("\n\n"), F.sha2(F.encode("word", "utf-8"), 256)))


def frequent(spark: SparkSession, held: DataFrame, path: str, most: int = HELD) -> DataFrame:
    """(key, pieces) of the most frequent pre-tokens, ``most`` at the most, written.

    Which ones these are is read off a bounded sample of ``held``; it decides how a pre-token meets its count, not what
    is counted.
    """
    words = held.where("word is not null")
    share = min(1.0, SAMPLE / max(1, held.count()))
    seen = words.sample(share, seed=6) if share < 1 else words
    seen = settled(spark, seen.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "pretokens-seen")
    digits = F.length(F.bin("df"))
    left, least = most, 65
    for r in seen.groupBy(digits.alias("digits")).count().orderBy(F.desc("digits")).collect():  # 64 rows at most
        if r["count"] > left:
            break
        left, least = left - r["count"], r["digits"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = pretoken_pieces(path, batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(pieces)], ["word", "pieces"])

    made = seen.where(digits >= least).select("word").mapInArrow(count, "word string, pieces long")
    return settled(spark, made.select(word_key().alias("key"), "pieces"), "pretoken-pieces")


def rare_tokens(held: DataFrame, path: str) -> DataFrame:
    """(row, tokens) of the pre-tokens in ``held`` (row, word, n): filed by pre-token, each distinct one is counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, int] = (None, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            known = words[0] == last[0]  # words are in order, so only the first may go on from the batch before
            pieces = pretoken_pieces(path, words[1:] if known else words)
            if known:
                pieces = np.concatenate([[last[1]], pieces])
            last = words[-1], int(pieces[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(pieces[codes] * batch.column("n").to_numpy())], ["row", "tokens"])

    return held.repartition("word").sortWithinPartitions("word").mapInArrow(count, "row long, tokens long")


def counted(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT, most: int = HELD) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row of ``docs`` (doc_id, text).

    Each row's pre-token frequencies meet the pieces of the distinct pre-tokens. By far most of them are
    frequent ones, of which a bounded number is broadcast, so these are never shuffled and make no hot keys; the
    rest is shuffled once, by pre-token.
    """
    kind = dict(docs.dtypes)["doc_id"]
    held = settled(spark, pretokens_of(docs), "pretokens", **{"parquet.dictionary.page.size": str(DICTIONARY_BYTES)})
    known = F.broadcast(frequent(spark, held, path, most))
    keyed = held.withColumn("key", word_key())
    met = keyed.join(known, "key", "left").select(
        "row", "doc_id", "n_bytes", (F.col("n") * F.col("pieces")).alias("tokens"))
    unmet = keyed.where("word is not null").join(known, "key", "left_anti").select("row", "word", "n")
    both = met.unionAll(rare_tokens(unmet, path).select(
        "row", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), "tokens"))
    sums = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                   F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Tokens of every document by the sentencepiece model at ``tokenizer``.

    Null and empty texts have none; special strings in texts are ordinary text; repeated rows each give a
    row; null doc_ids stay; an empty table gives no rows; other columns are ignored.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("piece_bpe_32k.model")
    return counted(spark, documents_of(spark, sf_dir), path)
