"""Base columns of secrets and quality rules over a whole table, against plain Python."""

import hashlib
import re

import pyarrow.parquet as pq

from terraframe.llm import quality_rules, secret_scan

KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"(AKIA[A-Z0-9]+)", 18),
    "hex": (r"([0-9a-f]+)", 16),
}


def texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in t}


def test_base_secrets(spark, sf):
    want = {}
    for i, t in texts(sf).items():
        found = [(m.start(), k, m.end(), name) for k, (name, (p, n)) in enumerate(KINDS.items()) for m in re.finditer(p, t, re.A) if len(m[1]) >= n]
        joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))
        want[i] = (*[sum(f[3] == k for f in found) for k in KINDS], hashlib.sha256(joined.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secret_scan.op2_secret_scan(spark, sf).collect()}
    assert got == want and any(any(x[:3]) for x in want.values())


def test_base_quality(spark, sf):
    want = {}
    for i, t in texts(sf).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places = {}
        for k in range(len(w) - 2):
            places.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeated = {k + j for p in places.values() if len(p) > 1 for k in p for j in range(3)}
        want[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))
    rows = quality_rules.op4_quality_rules(spark, sf).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows} == want
    assert all(not (r["base_failed"] and r["kept"]) for r in rows)
