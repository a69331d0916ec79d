"""Page exports with planted faults fail by name; what is pinned, cached or reviewed holds for its content only."""
from __future__ import annotations

import hashlib
import json

import pytest

from lectern.sources import exports, records

SHA = "a" * 64


def write(root, folder, change=None, newline="\n"):
    pages = [{"page": i, "markdown": f"page {i}\nmore", "text_chars": 11} for i in (1, 2)]
    text = "\n\n".join(f"<!-- source page {p['page']} -->\n\n{p['markdown']}" for p in pages)
    made = {"pages.json": {"schema_version": 1, "page_numbering": exports.NUMBERING, "parser": "x", "source_sha256": SHA, "pages": pages}, "metadata.json": {"parser": "x", "source": {"id": folder, "sha256": SHA, "pages": 2, "metadata": {"title": "T"}}},
            "run.json": {"parser": "x", "document": folder, "input_sha256": SHA, "status": "success", "expected_pages": 2, "parsed_pages": 2, "nonempty_pages": 2, "document_sha256": hashlib.sha256(text.encode()).hexdigest()}, "document.md": text}
    if change:
        change(made)
    (root / folder).mkdir()
    for name, content in made.items():
        (root / folder / name).write_bytes((content if isinstance(content, str) else json.dumps(content)).replace("\n", newline).encode())
    return {n: hashlib.sha256((c if isinstance(c, str) else json.dumps(c)).encode()).hexdigest() for n, c in made.items()}


def test_faults_have_names(spark, tmp_path):
    def repeat(m):
        m["pages.json"]["pages"][1]["page"] = 1

    hashes = {"good": write(tmp_path, "good"), "crlf": write(tmp_path, "crlf", newline="\r\n"), "repeat": write(tmp_path, "repeat", repeat), "torn": write(tmp_path, "torn", lambda m: m.pop("run.json")),
              "version": write(tmp_path, "version", lambda m: m["pages.json"].update(schema_version=2)), "other": write(tmp_path, "other", lambda m: m["run.json"].update(document="z")), "hash": write(tmp_path, "hash", lambda m: m["metadata.json"]["source"].update(sha256="b"))}
    found = exports.checked(exports.files(spark, str(tmp_path)))
    got = {r.folder: r.problems for r in found.collect()}
    assert got["good"] == got["crlf"] == [] and got["torn"] == ["missing or unreadable file"] and got["version"] == ["unsupported page contract"] and got["other"] == ["document identity mismatch"]
    assert got["hash"] == ["source hash mismatch", "invalid source hash"] and "missing, duplicate or unordered page" in got["repeat"]
    with pytest.raises(ValueError, match="unordered page"):
        exports.load(found.filter("folder = 'repeat'"))
    assert exports.load(found.filter("folder in ('good', 'crlf')")).count() == 4
    manifest = spark.createDataFrame([(f, "x", f, SHA, hashes["good"] | {"pages.json": "0"} if f == "good" else hashes["crlf"]) for f in ("good", "crlf")] + [("gone", "x", "gone", SHA, {})], "folder string, parser string, document_id string, source_sha256 string, sha256_utf8_lf map<string,string>")
    pinned = {r.folder: r.problems for r in exports.checked(exports.files(spark, str(tmp_path)), manifest).collect()}
    assert pinned["good"] == ["pinned hash mismatch"] and pinned["crlf"] == [] and pinned["gone"] == ["missing or unreadable file"] and "not in the manifest" in pinned["version"]


def test_matrix(spark):
    rows = [("a", "x", "1", 2), ("a", "y", "1", 2), ("b", "x", "1", 2), ("c", "x", "1", 2), ("c", "y", "2", 2), ("d", "x", "1", 1), ("d", "x", "1", 1), ("d", "y", "1", 1), ("e", "z", "1", 1)]
    frame = spark.createDataFrame(rows, "document_id string, parser string, source_sha256 string, n int").selectExpr("*", "array_repeat(1, n) AS pages")
    assert sorted(tuple(r) for r in exports.matrix_problems(frame, ["x", "y"]).collect()) == [("b", "missing parser"), ("c", "source differs by parser"), ("d", "duplicate input"), ("e", "missing parser")]


def test_checkpoints_chunks_and_cache(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pages = spark.createDataFrame([(1, 1, "a\r\nb", sha("a\nb")), (1, 2, "x", sha("y")), (1, 3, "z", sha("z")), (1, 3, "z", sha("z"))], "d int, p int, t string, h string")
    assert [r.problem for r in exports.resumed(pages, ["d", "p"], "t", "h").orderBy("p").collect()] == [None, "hash mismatch", "duplicate page", "duplicate page"]
    index = spark.createDataFrame([("page", "page_chunks.jsonl", sha("p"), "t"), ("section", "s.jsonl", sha("s"), "t"), ("v1", "v.jsonl", "", "t")], "strategy string, path string, sha256_utf8_lf string, tokenizer string")
    held = spark.createDataFrame([("page", "page_chunks.jsonl", "p"), ("section", "other", "S")], "strategy string, path string, content string")
    chunks = spark.createDataFrame([("page", "t"), ("page", "u"), ("none", "t")], "strategy string, tokenizer string")
    assert sorted(tuple(r) for r in exports.chunk_problems(index, held, chunks).collect()) == [("none", "strategy or tokenizer mismatch"), ("page", "strategy or tokenizer mismatch"), ("section", "hash mismatch"), ("section", "unexpected path"), ("v1", "missing chunk file")]
    asked = spark.createDataFrame([(1, "m", None), (2, "m", "q")], "i int, b string, a string")
    keys = {r.i: r.cache_key for r in exports.cached(asked, ["a", "b"], spark.createDataFrame([], "cache_key string, response string")).collect()}
    assert keys == {r.i: r.cache_key for r in exports.cached(asked, ["b", "a"], spark.createDataFrame([(keys[2], "hit")], "cache_key string, response string")).collect()}
    assert {r.i: r.response for r in exports.cached(asked, ["b", "a"], spark.createDataFrame([(keys[2], "hit")], "cache_key string, response string")).collect()} == {1: None, 2: "hit"}


def test_reviews_and_blocks(spark):
    labels = spark.createDataFrame([(i, f"h{i}", "draft") for i in range(1, 7)], "i int, h string, review_status string")
    made = spark.createDataFrame([(1, "h1", "human_verified", "ann"), (2, "zz", "human_verified", "ann"), (3, "h3", "adjudicated", None), (4, "h4", "best", "ann"), (5, "h5", "excluded", None), (9, "h9", "draft", "x"), (6, "h6", "draft", "x"), (6, "h6", "excluded", "x")], "i int, h string, review_status string, reviewer string")
    got = {r.i: (r.review_status, r.problem) for r in exports.reviewed(labels, made, "i", "h").collect()}
    assert got == {1: ("human_verified", None), 2: ("draft", "reviewed content differs"), 3: ("draft", "no reviewer"), 4: ("draft", "unknown status"), 5: ("excluded", None), 6: ("draft", "several decisions"), 9: (None, "unknown label")}
    blocks = spark.createDataFrame([([(2, "b"), (None, "z"), (1, "a"), (None, " ")],)], "b array<struct<order:int,text:string>>")
    assert blocks.select(exports.ordered_blocks(blocks["b"])).first()[0] == "a\n\nb\n\nz"


def test_strict_lines_and_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n[2]\n{"id": 1}\n')
    with pytest.raises(ValueError, match=r"a\.jsonl:3"):
        records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int")
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 1}\n')
    assert records.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id int").count() == 2
    with pytest.raises(ValueError, match="duplicate key"):
        records.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id int", unique=["id"])
    for name, text in (("r.json", '{"a": 1, "a": 2}'), ("n.json", '{"a": NaN}'), ("l.json", '{"a": "' + "x" * 500 + '"}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="strict JSON|too large"):
            records.read_record(spark, str(tmp_path / name), "a string", 100).collect()
    good = spark.createDataFrame([(1, 2.0)], "i int, v double")
    with pytest.raises(ValueError, match="not finite"):
        records.write_once(good.selectExpr("i", "double('NaN') AS v"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="too large"):
        records.write_once(good, str(tmp_path / "out"), max_bytes=3)
    records.write_once(good, str(tmp_path / "out"), max_bytes=300)
