"""Secrets against plain regular expressions; held-out quality of the two classifiers on the given tables."""

import hashlib
import re
import zlib

import numpy as np

SF = "/root/testdata/sf0.01"


def _held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


BASE = [("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16)]


def _plain(text):
    spans = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, rule, fits) in enumerate(BASE) for m in rule.finditer(text) if fits(m)]
    counts = [sum(x[1] == rank for x in spans) for rank in range(3)]
    return *counts, hashlib.sha256(",".join(s for _, _, s in sorted(spans)).encode()).hexdigest()


def test_secrets_against_regular_expressions(spark):
    from marketlens.llm.secrets import find_secrets

    draw = np.random.default_rng(3)
    parts = ["password", "PassWd", "secret", "tOKEN", "api_key", "apikey", "Api_Key", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAKIA", "ABCDEFGH12345678", "0123456789abcdef",
             "deadbeef", "abc", "é", "ß", "\n", "-", "A/b+c=d_e.f", "x" * 12, "Z9", "f" * 16, "_", "."]
    texts = ["".join(draw.choice(parts, draw.integers(1, 40))) for _ in range(3000)] + ["", None, "a" * 100_000 + "token=" + "b" * 100_000]
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = real + [(10_000 + i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == _plain(text or ""), text


def test_language_held_out(spark):
    from marketlens.llm.queries import op5_byte_cnn_language

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in op5_byte_cnn_language(spark, SF).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert all(_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got) and len(got) > 250
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) >= 0.97


def test_toxicity_held_out(spark):
    """On sf0.1 (AUC 0.947 when this was written; 0.877 on sf0.01, which has 18 held-out toxic documents; the bound is a floor, not the figure)."""
    from marketlens.llm.queries import op3_toxicity

    folder = SF.replace("0.01", "0.1")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(r["score"], r["predicted"], toxic[r["doc_id"]]) for r in op3_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in toxic]
    score, predicted, label = (np.array(x) for x in zip(*got, strict=True))
    assert (predicted == (score >= 0.7)).all() and score.min() >= 0 and score.max() <= 1
    pos, neg = score[label == 1], score[label == 0]
    assert (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean() >= 0.9
    assert predicted[label == 0].mean() <= 0.05 and predicted[label == 1].mean() >= 0.8
