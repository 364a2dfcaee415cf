"""The pipeline's stages, each on its own input, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from tidewater.llm import mixing, queries, secrets, toxicity
from tidewater.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies_kept(texts: dict[int, str], k: int = 5, percent: int = 80) -> set[int]:
    """The smallest doc_id of each class of near copies, by all pairs; documents without words all stay."""
    words = {d: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()} for d, w in words.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in sets if not sets[d] or find(d) == d}


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]

    def after(name, before):
        out = written(stages[name](spark, before, sf))
        assert name == "bpe" or out.columns == columns
        return out

    clean = after("toxicity", docs)
    weights, bias = toxicity.fit(toxicity.training(docs, labels))
    mask = weights != 0
    score = lambda t: bias + sum(float(weights[f]) for f in toxicity.presence([t], mask)[1])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, t in texts.items() if 1 / (1 + np.exp(-score(t))) < toxicity.THRESHOLD}
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    taught = [d for d in texts if marked.get(d) is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    assert sum(marked[d] == 0 for d in taught) == sum(marked[d] == 0 for d in taught if d in {r.doc_id for r in clean.collect()})

    single = after("near_duplicates", clean)
    assert {r.doc_id for r in single.collect()} == near_copies_kept({r.doc_id: r.text or "" for r in clean.collect()})

    hidden = after("secrets", single)
    before, spans = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r.spans for r in secrets.scan_documents(single).collect()}
    for r in hidden.collect():
        text, out, at = before[r.doc_id], [], 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[r.doc_id].split(",") if s):
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        assert r.text == (text if not out else "".join([*out, text[at:]]))
    assert hidden.count() == single.count() and any(spans.values())

    mix = after("mixing", hidden)
    plan = {r.doc_id: r for r in mixing.mix(hidden.withColumn("_key", hidden.doc_id), corpus_pipeline.PATTERN, corpus_pipeline.SHARE).collect()}
    whole = {r.doc_id: r.text or "" for r in hidden.collect()}
    taken = Counter()
    for r in mix.collect():
        n = len(WORD.findall(r.text))
        taken[r.source] += n
        assert r.text == whole[r.doc_id] or whole[r.doc_id].startswith(r.text) and n < len(WORD.findall(whole[r.doc_id]))
    goal = {r.source: plan[r.doc_id].target for r in hidden.collect()}
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)

    tool = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, bytes(r.ids)) for r in after("bpe", mix).collect())
    ids = [(r.doc_id, tool.encode(r.text or "", add_special_tokens=False).ids) for r in mix.collect()]
    assert got == Counter((d, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), np.array(x, "<u4").tobytes()) for d, x in ids)


def test_nothing_in_nothing_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
        assert docs.count() == 0
