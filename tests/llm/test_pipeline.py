import os
import re
import subprocess
import sys

import corpus_pipeline
from duelgrid.llm import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_feed_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == COLUMNS, name
        docs = after
    assert len(corpus_pipeline.STAGES) == 5


def test_run_against_the_stages_by_hand(spark, sf):
    """Each rule from its own brute force: the texts that stay, and their token counts."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from test_decontam import fold
    from test_neardup import brute
    from test_secret_scan import base_by_hand

    from duelgrid.llm import secret_scan

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [fold(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    stay = {i: t for i, t in docs.items() if re.search(r"[^\W\d_]", t or "")}
    stay = {i: stay[i] for i, _, _, kept in brute(sorted(stay.items())) if kept}
    stay = {i: t for i, t in stay.items() if not any(x in fold(t) for x in items)}
    want = []
    for i, t in stay.items():
        assert base_by_hand(t) == secret_scan.base_spans(t)
        t = secret_scan.masked(t, secret_scan.scan(t)[1], "[secret]")
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(want)


def test_odd_rows_pass_every_stage(spark, clashing, none, sf):
    for frame in (clashing, none):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf)
        assert frame.count() >= 0


def test_every_dealt_operator_has_its_query():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_nothing_else_imports_the_folder():
    found = subprocess.run(["grep", "-rln", "duelgrid.llm\\|corpus_pipeline", "--include=*.py", ROOT], capture_output=True, text=True).stdout.split()
    own = {os.path.relpath(f, ROOT) for f in found}
    assert all(f.startswith(("duelgrid/llm/", "tests/llm/")) or f in ("corpus_pipeline.py", "__spark_entry__.py") for f in own)
