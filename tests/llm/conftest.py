import pytest

from tests.llm.tables import odd_benchmark, odd_documents, write

SMALL = "/root/testdata/sf0.001"

PAGES = [
    (1, "http://a.example/1", "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head &amp; more</h1>"
     "<p>One\n two<br>three<p>Four</article><footer>foot</footer></body>"),
    (2, None, None), (3, "http://a.example/3", ""), (4, "http://a.example/4", "<p>no article <b>here"),
    (4, "http://a.example/4", "<p>no article <b>here"), (None, "bad url", "<main>x &lt;y&gt; <script>if (a<b) {}</script>z</main>"),
]
LABELS = [(6, 1, 0), (9, 1, 0), (10, 1, 0), (13, 0, 0), (15, 0, 1), (15, 0, 0), (17, 1, None), (None, 1, 1), (18, None, 0)]


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"), odd_documents(), odd_benchmark(), LABELS, PAGES)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [], [], [])
