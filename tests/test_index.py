import json
import os

import pytest
from pyspark.sql import functions as F

from passagemill import api
from passagemill.cli import live_mode, main
from passagemill.functions.hashing import hash_vector
from passagemill.operators.index import Index
from passagemill.operators.ingest import ingest
from passagemill.operators.rerank import keyword_overlap
from passagemill.operators.topk import cut_lineage
from passagemill.schemas import IngestError, Limits
from passagemill.session import ship

GUIDE = """# Dose

The night pill is 7 mg of agent QX-3.

# Parts

| sku | name |
| --- | --- |
| KT-5521-M | green panel |

# Setup

```
export TOOL=/srv/tool
```

The panel slides onto the frame before the bolt turns.
"""


@pytest.fixture()
def docs(tmp_path):
    folder = tmp_path / "docs"
    (folder / ".cache").mkdir(parents=True)
    (folder / "guide.md").write_text(GUIDE, encoding="utf-8")
    (folder / "memo.txt").write_text("Lunch is at noon.\n\nThe gate_code is on file.", encoding="utf-8")
    (folder / "_list.csv").write_text("sku,name\nZZ-1,lamp\n", encoding="utf-8")
    (folder / ".cache" / "page.html").write_text("<h1>Care</h1><p>Wipe the panel weekly.</p>", encoding="utf-8")
    (folder / ".hidden.md").write_text("secret", encoding="utf-8")
    (folder / "app.exe").write_text("x", encoding="utf-8")
    return folder


def _status(report):
    return {r.doc_id: r.status for r in report.collect()}


def test_ingest_search_replace_and_skip(spark, docs, tmp_path):
    ship(spark)
    home = str(docs / "index")
    report = ingest(spark, str(docs), home)
    assert _status(report) == dict.fromkeys([".cache/page.html", "_list.csv", "guide.md", "memo.txt"], "indexed")
    index = api.open_index(spark, home)
    hits = api.ask(index, "KT-5521-M", mode="bm25").hits.orderBy("rank").collect()
    assert "KT-5521-M" in hits[0].parent_text and hits[0].heading_path == "Parts"
    assert len(hits[0].file_sha256) == 64 and hits[0].source_path == "guide.md"
    assert [h.source_path for h in api.ask(index, "gate_code", mode="bm25").hits.collect()] == ["memo.txt"]
    assert api.ask(index, "code_gate", mode="bm25").hits.collect() == []
    only = api.ask(index, "panel", doc_id="guide.md", mode="rrf").hits.collect()
    assert {h.source_path for h in only} == {"guide.md"}
    assert api.ask(index, "panel", doc_id="none.md", mode="dense").hits.collect() == []

    old = index.child_ids("memo.txt")
    n_old, others = old.count(), index.live("children").where("doc_id <> 'memo.txt'").count()
    stale = cut_lineage(old)
    (docs / "memo.txt").write_text("Dinner is at eight.", encoding="utf-8")
    os.remove(docs / "_list.csv")
    again = _status(ingest(spark, str(docs), home))
    assert again == {".cache/page.html": "skipped", "guide.md": "skipped", "memo.txt": "indexed"}
    index.refresh()
    live = index.live("children")
    assert n_old == 1 and live.join(stale, "chunk_id", "left_semi").isEmpty()
    assert [r.text for r in live.where("doc_id = 'memo.txt'").collect()] == ["Dinner is at eight."]
    assert live.where("doc_id <> 'memo.txt'").count() == others
    assert {h.source_path for h in api.ask(index, "dinner lamp", mode="bm25").hits.collect()} == {"memo.txt", "_list.csv"}
    n = index.live("children").count()
    index.compact()
    assert index.live("children").count() == n and len(index.gens) == 1
    assert api.ask(index, "dinner", mode="bm25").hits.count() == 1
    with pytest.raises(IngestError, match="ingest again"):
        api.open_index(spark, home, "other-model", "1")
    with pytest.raises(IngestError, match="8 numbers, the encoder makes 4"):
        (docs / "memo.txt").write_text("Supper is late.", encoding="utf-8")
        ingest(spark, str(docs), home, encode=lambda t: hash_vector(t, dim=4))


def test_only_new_texts_are_encoded(spark, docs, tmp_path):
    home = str(tmp_path / "index")
    ingest(spark, str(docs), home)
    index = api.open_index(spark, home)
    first = index.table("embeddings").count()
    (docs / "copy.md").write_text(GUIDE, encoding="utf-8")
    ingest(spark, str(docs), home)
    index.refresh()
    assert index.table("embeddings").count() == first
    assert index.live("children").where(F.col("vector").isNull()).count() == 0
    assert index.live("children").where("doc_id = 'copy.md'").count() == index.live("children").where("doc_id = 'guide.md'").count()


def test_gates_stop_at_the_first_refused_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("fine", encoding="utf-8")
    (folder / "b.html").write_text("<script>x()</script>", encoding="utf-8")
    (folder / "c.md").write_text("also fine", encoding="utf-8")
    home = str(tmp_path / "index")
    with pytest.raises(IngestError, match="b.html: no text"):
        ingest(spark, str(folder), home)
    index = api.open_index(spark, home)
    assert [r.doc_id for r in index.files().collect()] == ["a.md"]
    report = {r.doc_id: (r.status, r.reason) for r in ingest(spark, str(folder), home, fail_fast=False).collect()}
    assert report == {"a.md": ("skipped", None), "b.html": ("refused", "no text"), "c.md": ("indexed", None)}
    with pytest.raises(IngestError, match="larger than"):
        ingest(spark, str(folder / "c.md"), str(tmp_path / "i2"), limits=Limits(max_file_bytes=4))
    with pytest.raises(IngestError, match="too many chunks"):
        ingest(spark, str(folder / "c.md"), str(tmp_path / "i3"), limits=Limits(max_chunks=0))
    elsewhere = tmp_path / "elsewhere"
    elsewhere.mkdir()
    (elsewhere / "plan.txt").write_text("not for this index", encoding="utf-8")
    (folder / "0.txt").symlink_to(elsewhere / "plan.txt")
    rows = ingest(spark, str(folder), str(tmp_path / "i4"), fail_fast=False).collect()
    assert [r.reason for r in rows if r.status == "refused"] == ["leads out of the folder", "no text"]
    assert api.ask(api.open_index(spark, str(tmp_path / "i4")), "plan index", mode="bm25").hits.isEmpty()


def test_command_line(spark, docs, tmp_path, capsys):
    home = str(tmp_path / "index")
    assert main(["query", "  ", "--index", home], spark) == 1
    assert "empty query" in capsys.readouterr().err
    assert main(["ingest", str(docs / "app.exe"), "--index", home], spark) == 1
    assert "unsupported file type" in capsys.readouterr().err
    assert main(["query", "panel", "--index", home], spark) == 0
    assert capsys.readouterr().out.strip() == "no hits" and not os.path.exists(home)
    assert main(["ingest", str(docs), "--index", home], spark) == 0
    assert "indexed  guide.md  4" in capsys.readouterr().out
    assert main(["query", "KT-5521-M", "--index", home, "--mode", "bm25"], spark) == 0
    out = capsys.readouterr().out
    assert out.startswith("1.0000  uncertain  guide.md  Parts  p.-  chars ")
    golden = tmp_path / "golden.jsonl"
    golden.write_text(
        '{"q": "KT-5521-M", "doc_id": "guide.md", "must_contain": "KT-5521-M", "expect": "Green", "kind": "lexical"}\n\n'
        '{"q": "How is the panel fixed?", "doc_id": "guide.md", "must_contain": "slides onto", "expect": "glue", "kind": "semantic"}\n'
        '{"q": "Who won?", "kind": "unanswerable"}\n'
    )
    saved = tmp_path / "report.json"
    written = tmp_path / "answers.jsonl"
    written.write_text('{"q": "KT-5521-M", "answer": "It is the green panel."}\n{"q": "How is the panel fixed?", "answer": "By a bolt."}\n')
    asked = ["eval", "--index", home, "--golden", str(golden), "--report", str(saved), "--answers", str(written)]
    assert main(asked, spark) == 0
    out = capsys.readouterr().out
    assert "bm25       lexical    recall@5=1.00 mrr=1.00 abstain=0.00" in out and "live=" in out
    assert "span=0.50 n=2" in out and json.loads(saved.read_text())["span_n"] == 2
    assert saved.exists() and api.open_index(spark, home).get_tau() is not None
    assert live_mode(home) == "cascade"
    (tmp_path / "index" / "report.json").write_text('{"live_mode": "bm25"}', encoding="utf-8")
    assert main(["query", "KT-5521-M", "--index", home], spark) == 0
    assert capsys.readouterr().out.startswith("1.0000  uncertain  guide.md  Parts  p.-  chars ")


def test_a_threshold_belongs_to_its_scorer(spark, docs, tmp_path):
    home = str(tmp_path / "index")
    ingest(spark, str(docs), home)
    index = api.open_index(spark, home)

    def half(query, text):
        return keyword_overlap(query, text) / 2

    index.set_tau(3.0)
    assert index.get_tau() == 3.0 and index.get_tau(half) is None
    assert index.corpus(half).tau is None
    index.set_tau(1.5, half)
    assert (index.get_tau(), index.get_tau(half)) == (3.0, 1.5)


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both begin before either commits; the later commit counts for a document that both wrote."""
    ship(spark)
    home = str(tmp_path / "index")
    for name, texts in (("a", {"x.md": "x of a", "y.md": "y of a"}), ("b", {"x.md": "x of b", "z.md": "z of b"}), ("0", {"x.md": "first"})):
        (tmp_path / name).mkdir()
        for file, text in texts.items():
            (tmp_path / name / file).write_text(f"# T\n\n{text}", encoding="utf-8")
    ingest(spark, str(tmp_path / "0"), home)
    late, plain = [], Index.commit

    def commit(self, gen, dim, replaces=None):
        if not late:  # the writer of a is overtaken between its writes and its commit
            late.append(gen)
            ingest(spark, str(tmp_path / "b"), home)
        plain(self, gen, dim, replaces)

    Index.commit = commit
    try:
        ingest(spark, str(tmp_path / "a"), home)
    finally:
        Index.commit = plain
    index = api.open_index(spark, home)
    assert index.gens == [1, 3, 2] and late == [2]
    texts = {r.doc_id: r.text for r in index.live("children").collect()}
    assert texts == {"x.md": "x of a", "y.md": "y of a", "z.md": "z of b"}
    assert {r.doc_id: r.gen for r in index.files().collect()} == {"x.md": 2, "y.md": 2, "z.md": 3}
    assert {h.source_path for h in api.ask(index, "of b", mode="bm25").hits.collect()} == {"x.md", "y.md", "z.md"}
    # A rewrite that is overtaken starts again from what is there then.
    rewriter, overtaken = api.open_index(spark, home), []

    def interrupted(self, gen, dim, replaces=None):
        if replaces is not None and not overtaken:
            overtaken.append(gen)
            (tmp_path / "b" / "z.md").write_text("# T\n\nz again", encoding="utf-8")
            ingest(spark, str(tmp_path / "b"), home)
        plain(self, gen, dim, replaces)

    Index.commit = interrupted
    try:
        rewriter.compact()
    finally:
        Index.commit = plain
    assert len(rewriter.gens) == 1 and rewriter.gens != overtaken
    # The folder b was listed whole: its x.md differs from what stands for x.md, so it counts now.
    assert {r.doc_id: r.text for r in rewriter.live("children").collect()} == {"x.md": "x of b", "y.md": "y of a", "z.md": "z again"}


def test_wide_tables_are_written_by_the_tasks_that_hold_them(spark, tmp_path):
    """Texts are stored once and postings with their ranges in one pass; no exchange moves them before they are written."""
    home, folder = str(tmp_path / "index"), tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text(GUIDE, encoding="utf-8")
    ship(spark)
    ingest(spark, str(folder), home)
    index = api.open_index(spark, home)
    raw = spark.read.parquet(f"{home}/children")
    assert "embed_text" not in raw.columns
    rows = index.live("children").collect()
    assert rows and all(r.embed_text == (f"{r.heading_path}\n{r.text}" if r.heading_path else r.text) for r in rows)
    stored = spark.read.parquet(f"{home}/postings")
    assert stored.where("term IS NULL").count() == index.table("ranges").count() > 0
    assert index.postings().blocks.where("term IS NULL").isEmpty()
    assert index.postings().stats()[0] == len(rows)
