"""The pipeline against its stages in plain Python."""

import ast
import os

import duckdb

import corpus_pipeline
from tabwright.llm import bpe, secrets
from tests.llm import brute
from tests.llm.test_jaccard import keep_one
from tests.llm.test_quality import verdicts

SF = "/root/testdata/sf0.001"


def redact(text):
    spans, out, at = sorted((a, b) for _, a, b in brute.op5(text)), [], 0
    for a, b in spans:
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:]


def test_run_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    good = [(i, t) for (i, t, s), k in zip(rows, verdicts([(t, s) for _, t, s in rows]), strict=True) if k]
    ids = keep_one(good)
    kept = [row for row in good if row[0] in ids]
    library = brute.library(bpe.default_tokenizer_path())
    want = {i: [*library.encode(redact(t), add_special_tokens=False).ids, 1] for i, t in kept}
    got = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
    assert {i: len(x) // 4 for i, x in got.items()} == {i: len(x) for i, x in want.items()}
    assert {i: [int.from_bytes(x[k : k + 4], "little") for k in range(0, len(x), 4)] for i, x in got.items()} == want


def test_stages_keep_the_columns(spark, edge):
    docs = edge.limit(100)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    assert secrets.Battery().false_discovery == 0.05


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "tabwright")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, name)).read())
                modules = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                assert not any(m.startswith("tabwright.llm") or m == "corpus_pipeline" for m in modules), name
