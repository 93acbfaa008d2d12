"""Questions to answer records, replies for every request of a stream, and file options."""

import json

from passagemill import Settings, answer_questions, ingest, load_store
from passagemill.streaming.search import search_stream


def test_answers_and_replies(spark, tmp_path):
    def load():
        def reply(prompt):
            if "trains" in prompt.split("\n")[0]:
                raise ValueError("no trains")
            return f"{len(prompt)} characters"

        return reply

    root, store = tmp_path / "docs", str(tmp_path / "store")
    root.mkdir()
    (root / "a.md").write_bytes("bläue und grün ".encode("cp1252") * 20)
    (root / "t.csv").write_text("a;b\n1;2\n")
    settings = Settings(encodings=("ascii", "cp1252"), table_sep=";", preview_chars=5)
    ingest(spark, str(root), store, str(tmp_path / "m"), settings=settings)
    rows = load_store(spark, store)
    assert any("bläue" in r.content for r in rows.collect()) and any("Columns: a, b" in r.content for r in rows.collect())
    asked = spark.createDataFrame([(1, "bläue"), (2, "trains"), (3, " "), (4, None)], "q_id long, query string")
    got = {r.q_id: r for r in answer_questions(asked, rows, load, settings).collect()}
    assert got[1].answer.endswith("characters") and got[1].sources[0].content_preview.endswith("...") and len(got[1].sources[0].content_preview) == 8
    assert (got[2].answer, got[2].sources) == ("Error: no trains", [])
    assert (got[3].answer, got[4].answer) == ("Error: empty query", "Error: missing query")

    bodies, output, replies = (str(tmp_path / n) for n in ("bodies", "hits", "replies"))
    spark.createDataFrame([(1, '{"query": "grün", "k": 1}'), (2, "nope"), (3, '{"query": "x", "k": 2.5}'), (4, '{"query": "y", "k": 0}')],
                          "q_id long, body string").write.parquet(bodies)
    stream = spark.readStream.schema("q_id long, body string").parquet(bodies)
    search_stream(stream, store, output, str(tmp_path / "p"), replies=replies).awaitTermination()
    got = {r.q_id: r for r in spark.read.parquet(f"{replies}/batch=*").collect()}
    assert {q: r.status for q, r in got.items()} == {1: "answered", 2: "rejected", 3: "rejected", 4: "answered"}
    assert (got[2].reason, got[3].reason) == ("missing query", "k is no whole number that fits")
    assert json.loads(got[1].response)["count"] == 1 and json.loads(got[4].response)["results"] == []
