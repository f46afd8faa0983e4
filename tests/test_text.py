import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from lodewright.conf import Llm
from lodewright.functions import boxes, text, vectors
from lodewright.operators import models


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


def test_tokens_drop_stop_words(spark):
    assert one(spark, text.tokens(F.lit("The accuracy of the model, was 92.4%!"))) == ["accuracy", "model", "92", "4"]


@pytest.mark.parametrize(("raw", "clean"), [("signi-  ficant", "significant"), ("  a \n b ", "a b"), ("ﬁnd ﬄ", "find ffl"), ("", ""), (None, "")])
def test_cleaning(spark, raw, clean):
    assert one(spark, text.clean_ocr(F.lit(raw).cast("string"))) == clean


def test_overlap(spark):
    assert one(spark, text.lexical_overlap(F.lit("random forest accuracy"), F.lit("a random forest"))) == pytest.approx(2 / 3)
    assert one(spark, text.lexical_overlap(F.lit("the of"), F.lit("x"))) == 0.0


def test_citations_and_refusals(spark):
    assert one(spark, text.citations(F.lit("as in [a#r1] and [ b ] [] [[x]]"))) == ["a#r1", "b", "x"]
    assert one(spark, text.is_refusal(F.lit("This is NOT STATED anywhere"))) is True
    assert one(spark, text.supported(F.lit("yes"), F.lit(False))) is False


def test_cache_key_has_a_zero_after_every_part(spark):
    import hashlib

    want = hashlib.sha256(b"stub\0m\0\0hello\0").hexdigest()
    assert one(spark, text.cache_key(F.lit("stub"), F.lit("m"), F.lit("hello"))) == want


def test_stub_answers(spark):
    assert one(spark, text.stub_answer(F.lit("a trigger here"), {"trigger": "given"})) == "given"
    assert '"faithfulness"' in one(spark, text.stub_answer(F.lit("Rate Faithfulness")))
    assert one(spark, text.stub_answer(F.lit("x"))).startswith("Stub answer derived")


def test_judge_replies(spark):
    good = one(spark, text.judged(F.lit('so: {"faithfulness": 0.5, "relevance": 1}')))
    assert (good["faithfulness"], good["relevance"]) == (0.5, 1.0)
    assert one(spark, text.judged(F.lit('{"faithfulness": 1.5}'))) is None
    assert one(spark, text.judged(F.lit("no json"))) is None
    assert one(spark, text.judged(F.lit('{"relevance": 0.25}')))["faithfulness"] == 0.0


def test_fenced_question(spark):
    got = one(spark, text.question_reply(F.lit('```json\n{"question": "What was measured?", "answer": "x"}\n```')))
    assert got["question"] == "What was measured?"
    assert one(spark, text.question_reply(F.lit('{"question": "short"}'))) is None


@pytest.mark.parametrize(
    ("key", "parts"), [("PMC1_2_00007", ("PMC1_2", "00007")), ("noPageSuffix", ("noPageSuffix", "0")), ("_x", ("_x", "0")), (" a_b ", ("a", "b"))]
)
def test_key_parts(spark, key, parts):
    assert tuple(one(spark, boxes.key_parts(F.lit(key)))) == parts


def test_boxes(spark):
    b = boxes.box(F.lit(400), F.lit(400), F.lit(500), F.lit(500))
    assert tuple(one(spark, boxes.clipped(b, F.lit(500), F.lit(500)))) == (400, 400, 100, 100)
    assert tuple(one(spark, boxes.corners(boxes.box(F.lit(0.5), F.lit(1.5), F.lit(2), F.lit(1))))) == (0, 2, 2, 2)
    assert one(spark, boxes.area(boxes.box(F.lit(0), F.lit(0), F.lit(-2), F.lit(3)))) == 0.0
    assert tuple(one(spark, boxes.upscaled(F.lit(30), F.lit(50), 200))) == (120, 200)
    assert tuple(one(spark, boxes.upscaled(F.lit(30), F.lit(50), 0))) == (30, 50)


@pytest.mark.parametrize(
    ("annotation", "kind", "box"),
    [
        ('{"category_id": 5, "bbox": [1, 2, 3, 4]}', "figure", (1, 2, 3, 4)),
        ('{"category": " Title ", "box": {"x": 1, "y": 2, "w": 3, "h": 4}}', "title", (1, 2, 3, 4)),
        ('{"label": "3", "bbox": [1, 2, 5, 9], "format": "xyxy"}', "list", (1, 2, 4, 7)),
        ('{"category_id": null, "category": 1, "bbox": null, "bounding_box": [0, 0, 9, 9, 7]}', None, (0, 0, 9, 9)),
        ('{"category_id": true, "bbox": [1, 2, 3]}', None, None),
        ('{"category_id": 2.9, "bbox": "x"}', "title", None),
        ('{"category_id": 99}', None, None),
    ],
)
def test_annotations(spark, annotation, kind, box):
    v = F.parse_json(F.col("a"))
    df = spark.createDataFrame([(annotation,)], "a string")
    row = df.select(boxes.category(v).alias("k"), boxes.annotation_box(v).alias("b")).first()
    assert row["k"] == kind
    assert (tuple(row["b"]) if row["b"] else None) == box


def test_vectors(spark):
    assert one(spark, vectors.slot(F.lit("accuracy"), 64)) == 8
    assert one(spark, vectors.slot(F.lit("model"), 64)) == 12
    assert one(spark, vectors.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vectors.normalised(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        vectors.slot(F.lit("x"), 60)


class _Chat(http.server.BaseHTTPRequestHandler):
    refused = 0

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        status, said = 200, {"choices": [{"message": {"content": asked["messages"][-1]["content"].upper()}}]}
        if asked["model"] == "busy" and _Chat.refused < 2:
            _Chat.refused += 1
            status = 429
        elif asked["model"] == "nobody":
            status = 400
        self.send_response(status)
        self.send_header("Retry-After", "0")
        self.end_headers()
        self.wfile.write(json.dumps(said).encode())

    def log_message(self, *_):
        pass


def test_hosted_models(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    try:
        asked = models.keyed(spark.createDataFrame([("one",), ("two",), ("one",)], "prompt string"), "x", "m")
        none = spark.createDataFrame([], "key string, reply string")
        got = sorted(r["reply"] for r in models.complete(asked, none, models.hosted("m", base_url=url)).collect())
        assert got == ["ONE", "TWO"]
        busy = models.hosted("busy", base_url=url)()
        assert models.patient(lambda: busy("hi", "be brief")) == "HI"
        with pytest.raises(RuntimeError, match="400"):
            models.patient(lambda: models.hosted("nobody", base_url=url)()("hi", None))
    finally:
        server.shutdown()
    gone = models.hosted("m", base_url=url)()
    server.server_close()
    with pytest.raises(models.TransientError):
        gone("hi", None)
    with pytest.raises(ValueError, match="no address"):
        models.hosted("m")
    with pytest.raises(ValueError, match="NO_SUCH_KEY"):
        models.hosted("m", base_url=url, api_key_env="NO_SUCH_KEY")()
    with pytest.raises(ValueError, match="stub"):
        models.of(Llm())
