"""The fit of the classifier and the whole pipeline against plain Python over a small fixture."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from inkveil.llm import bpe, quality

NOTICE = "Subscribe to our newsletter today"
rnd = random.Random(5)
VOCABULARY = ["".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 9))) for _ in range(300)]


def _prose(n=120):
    words = rnd.choices(VOCABULARY, k=n)
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def _junk():
    return " ".join("".join(rnd.choices("0123456789#$%&*!ABCXYZ", k=rnd.randint(1, 6))) for _ in range(90))


ITEM = " ".join(rnd.choices(VOCABULARY, k=14))
TEXTS = {i: _junk() if i % 3 == 0 else _prose() for i in range(100)}
TEXTS |= {i: _prose() + f"\n  {NOTICE.upper()} " for i in range(100, 112)}  # a line of 12 documents
TEXTS |= {120: TEXTS[4], 121: TEXTS[5].replace(TEXTS[5].split()[60], "changed", 1), 122: TEXTS[101]}  # copies, exact and near
TEXTS |= {130: _prose() + "\n" + ITEM + "\n" + _prose(), 131: _prose() + " " + " ".join(ITEM.split()[:9]), 140: "", 141: None, 142: _prose() + "\n\U0001f600 naïve <|x|>"}
LABELS = {i: int(i % 3 > 0) for i in range(95)}
ITEMS = {1: ITEM, 2: None, 3: "", 4: "only here"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in LABELS.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def _scores():
    """Every cosine with every labelled row outside the fold, sorted in full."""
    fold = [i for i in sorted(LABELS) if zlib.crc32(str(i).encode()) % 4 != 2]
    raw = lambda t: quality.features((t or "").encode()).astype(np.float64)
    x, y = np.stack([raw(TEXTS[i]).astype(np.float16).astype(np.float64) for i in fold]), np.array([LABELS[i] for i in fold], float)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1
    mean = (x * weight).mean(axis=0)
    basis = np.linalg.svd(x * weight - mean, full_matrices=False)[2][:48].T
    unit = lambda v: v / np.linalg.norm(v)
    known = [unit((r * weight - mean) @ basis) for r in x]
    out = {}
    for i, t in TEXTS.items():
        if len((t or "").encode()) < 4:
            out[i] = y.mean()
            continue
        v = unit((raw(t) * weight - mean) @ basis)
        near = sorted(((float(v @ k), l) for k, l in zip(known, y)), reverse=True)[:25]
        w = [max(c, 0) ** 4 + 1e-9 for c, _ in near]
        out[i] = sum(a * l for a, (_, l) in zip(w, near)) / sum(w)
    return out


def test_classifier_as_brute_force(spark, folder):
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    want = _scores()
    got = {r.doc_id: r for r in quality.classify(read("documents"), read("labels")).collect()}
    assert set(got) == set(want) and all(abs(got[i].score - s) < 1e-3 for i, s in want.items())
    assert all(got[i].predicted == q for i, q in LABELS.items() if got[i].held_out)


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_as_brute_force(spark, folder):
    from tokenizers import Tokenizer

    docs = {i: TEXTS[i] or "" for i, s in _scores().items() if s >= 0.7}
    key = lambda line: re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    seen = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    docs = {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for i, t in docs.items()}
    assert not any(NOTICE.upper() in t for t in docs.values())
    sets, group = {i: _shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    for i in docs:
        for j in docs:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert [i for i in group if group[i] != i] == [120, 121, 122]
    docs = {i: t for i, t in docs.items() if group[i] == i}
    windows = set()
    for t in ITEMS.values():
        w = _words(t or "")
        windows |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    hit = {i for i, t in docs.items() if any(f" {w} " in f" {' '.join(_words(t))} " for w in windows)}
    assert hit == {130}
    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_truncation(), lib.no_padding()
    want = {}
    for i in docs.keys() - hit:
        ids = lib.encode(docs[i], add_special_tokens=False).ids
        want[i] = len(ids), ids, lib.decode(ids, skip_special_tokens=False)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in got} == want and len(got) == len(want) > 60
