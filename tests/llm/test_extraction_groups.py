from caselight.llm import extraction

SCHEMA = "page_id long, url string, html string"


def page(i, host="a"):
    """Pages of one host without an article: three or two of them share a notice, each has words of its own."""
    own = " ".join(f"w{host}{i}x{j}" for j in range(12))
    shared = "this notice of ten words stands on many pages here"
    rare = "that notice of ten words stands on two pages only"
    return (i, f"http://{host}.example/{i}", f"<p>{own}<p>{shared if i < 6 else rare}" + ("<p>" + own if i % 2 else ""))


ROWS = [page(i) for i in range(8)] + [page(i, "b") for i in range(2)]
ROWS += [(9, "http://a.example/9", ROWS[6][2]), (10, "http://a.example/10", ""), (11, "http://a.example/11", None), ROWS[0],
         (12, "http://a.example/12", "<article>this notice of ten words stands on many pages here</article><p>x")]


def test_what_pages_of_different_groups_repeat_goes(spark, monkeypatch):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    texts = {}
    for size in (1 << 40, 40):
        monkeypatch.setattr(extraction, "GROUP_BYTES", size)
        texts[size] = sorted(map(tuple, extraction.extracted(spark, frame).collect()), key=str)
    assert texts[40] == texts[1 << 40] and len(texts[40]) == len(ROWS)
    kept = {r[0]: r[2] for r in texts[40] if r[1] and "a.example" in r[1]}
    assert "notice" not in kept[0] and "that notice" in kept[7] and "notice" in kept[12]
