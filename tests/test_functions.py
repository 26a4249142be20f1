"""Scalar functions: folds, tokens, similarity, time. Values by hand."""

import json
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernel.functions import embedding, similarity, temporal, text


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_folds(spark):
    assert one(spark, text.nocase(F.lit("PHÚC Ab"))) == "phÚc ab"
    assert one(spark, text.unicode_fold(F.lit("PHÚC"))) == "phúc"
    assert one(spark, text.term_fold(F.lit("Phúc năm mẹ tiếng Việt nguyễn Đà"))) == "phuc nam me tiếng việt nguyễn đa"


def test_terms(spark):
    assert one(spark, text.terms(F.lit("Foo-bar_BAZ & 12x  é"))) == ["foo", "bar", "baz", "12x", "e"]
    assert one(spark, text.terms(F.lit(None).cast("string"))) == []


def test_seed_words(spark):
    assert one(spark, text.seed_words(F.lit("What is the Project_X of An, a b Đà Lạt của tôi?"))) == ["project_x", "of", "an", "đà", "lạt"]
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 64


@pytest.mark.parametrize(("name", "word", "hit"), [("Anna Lee", "anna", True), ("Annabel", "anna", False), ("x_anna", "anna", False), ("a+b", "a+b", True), ("Đà Lạt", "đà", True), ("C\\E(x)", "\\E", False), ("", "a", False)])
def test_whole_word(spark, name, word, hit):
    assert one(spark, text.whole_word(F.lit(name), word)) is hit


def test_query_cleaning_and_lists(spark):
    assert text.clean_query('a "b" & c-d') == "a  b    c d"
    assert text.clean_query('x|y* (z)^', entity_mode=True) == "x y   z"
    assert one(spark, text.csv_list(F.lit(" a, b ,, c "))) == ["a", "b", "c"]
    assert one(spark, text.joined_list(F.lit("a|||b||||||c"))) == ["a", "b", "c"]


@pytest.mark.parametrize(("a", "b", "want"), [([1, 0], [1, 0], 1), ([1, 0], [0, 1], 0), ([1, 0], [-1, 0], -1), ([0, 0], [1, 0], 0), ([1], [1, 0], 0), ([], [], 0), ([1, 1], [1, 0], 0.5**0.5)])
def test_cosine(spark, a, b, want):
    arr = lambda x: F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")
    assert one(spark, similarity.cosine(arr(a), arr(b))) == pytest.approx(want)


def test_distances(spark):
    a, b = F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))
    assert one(spark, similarity.l2(a, b)) == pytest.approx(5)
    assert one(spark, similarity.distance_score(F.lit(0.5))) == 0.75 and one(spark, similarity.distance_score(F.lit(3.0))) == 0


def test_jaro_and_winkler():
    assert similarity.jaro("martha", "marhta") == pytest.approx(0.9444, abs=1e-4)
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler(" Anna ", "anna") == similarity.jaro("", "") == 1.0
    assert similarity.jaro("", "a") == similarity.jaro(None, "a") == similarity.jaro("abc", "xyz") == 0.0
    assert similarity.jaro("phúc", "phuc") == pytest.approx(0.8333, abs=1e-4)
    assert similarity.jaro_winkler("abcdxxxx", "abcdyyyy") == pytest.approx(0.8)


def test_fake_embedding(spark):
    got = one(spark, similarity.fake_embedding(F.lit("hello"), 128))
    assert got == embedding.vector_of(spark, "hello", embedding.open_source(dimensions=128)) and len(got) == 128 and all(-1 <= x <= 1 for x in got)
    with pytest.raises(ValueError, match="nothing"):
        embedding.open_source("nothing")


def test_endpoint(spark):
    """A small server that answers with the length of the prompt; an error is one here, too."""
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Answers(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"embedding": [len(asked["prompt"]), 1]}).encode()
            self.send_response(200 if asked["model"] == "m" and self.path == "/x/api/embeddings" else 500)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/x/"
    rows = spark.createDataFrame([("ab",), (None,), ("",)], "t string").coalesce(1)
    made = embedding.open_source("ollama", model="m", dimensions=2, base_url=base, prefix="q:")
    assert [r.embedding for r in embedding.with_embedding(rows, "t", made).collect()] == [[4.0, 1.0], None, [2.0, 1.0]]
    with pytest.raises(OSError, match="500"):
        embedding.vector_of(spark, "a", embedding.open_source("ollama", model="other", dimensions=2, base_url=base))
    server.shutdown()


def test_custom_embedder(spark):
    class Lengths:
        dimensions = 1

        def vectors(self, texts):
            return pa.array([[float(len(t))] for t in texts.to_pylist()], pa.list_(pa.float64()))

    rows = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    assert [r.embedding for r in embedding.with_embedding(rows, "t", Lengths()).collect()] == [[2.0], None, [0.0]]


@pytest.mark.parametrize(("q", "want"), [("năm 2025", (2025, 1, 12)), ("chuyện năm nay", (2026, 1, 12)), ("năm ngoái", (2025, 1, 12)), ("năm  trước", (2025, 1, 12)), ("tháng 2/2024", (2024, 2, 2)), ("tháng 12 năm 2023", (2023, 12, 12)), ("in 2024 ok", (2024, 1, 12)), ("year 1950", (1950, 1, 12)), ("tháng 13/2024", (2024, 1, 12)), ("nothing", None), ("id 123456", None), ("year 9999", None)])
def test_temporal_range(spark, q, want):
    got = tuple(one(spark, temporal.temporal_range(F.lit(q), F.lit(date(2026, 5, 1)))))
    assert got == ((None, None) if want is None else (date(want[0], want[1], 1), date(want[0], want[2], 29 if want[2] == 2 else 31)))


@pytest.mark.parametrize(("w", "days", "want"), [(0.8, 30, 0.4), (0.6, 60, 0.15), (0.2, 180, 0.1)])
def test_decay(spark, w, days, want):
    assert one(spark, temporal.decayed(F.lit(w), F.lit(days), 30, 0.1)) == pytest.approx(want)
