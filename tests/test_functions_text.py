"""Accents are stripped from whole texts in every language, against brute force."""

import unicodedata

from tidewater.plans import registry


def test_whole_texts(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    got = {r.doc_id: r.bare for r in registry.queries()["accent_strip"](spark, sf).collect()}
    assert got == {d: None if r.text is None else bare(r.text) for d, r in docs.items()}
    assert any(got[d][40:] != r.text[40:] and r.lang not in ("fr", "es") for d, r in docs.items() if r.text)
