"""Order MinHash: against one-by-one selection, and its likeness on edited texts."""
import hashlib
import random
import struct

import xxhash
from conftest_llm import ODD, docs_of, words_of  # noqa: F401  (docs_of is a fixture)
from pyspark.sql import functions as F

from cohort_spark.llm import order_minhash as O

LOW = (1 << O.POSITION_BITS) - 1


def chain(parts, seed=42):
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed


def long_(x):
    return struct.pack("<Q", x)


def brute(text, k=O.KMER, picks=O.PICKS, coordinates=O.COORDINATES):
    """Coordinates by sorting all numbered k-mers for each order."""
    words = [chain([w.encode()]) for w in words_of(text)]
    if not words:
        return [chain([b""]) >> 32] * coordinates
    runs = [chain(map(long_, words[i: i + k])) for i in range(len(words) - k + 1)] if len(words) >= k else [chain(map(long_, words))]
    seen, places = {}, []
    for i, h in enumerate(runs):
        occurrence = seen.get(h, 0)
        seen[h] = occurrence + 1
        places.append((chain([long_(h), struct.pack("<i", occurrence)]) & ~LOW) | i)
    out = []
    for j in range(coordinates):
        # the ring of signed numbers begins at -2^63
        point = (((j * ((1 << 64) // coordinates) + (1 << 63)) >> O.LONG_BITS << O.LONG_BITS) | LOW) % (1 << 64)
        least = sorted(places, key=lambda p: (p - point) % (1 << 64))[:picks]
        out.append(chain(long_(runs[i]) for i in sorted(p & LOW for p in least)) >> 32)
    return out


def hexed(coordinates):
    return "".join(f"{c:08x}" for c in coordinates)




def test_every_coordinate_and_the_next_document(spark, docs_of):  # noqa: F811
    r = random.Random(5)
    vocabulary = [f"v{i}é" for i in range(40)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 30, 400])))) for i in range(40)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(ODD) if t is None or len(t) < 1000] + [(7_000, "tail of the table")]
    got = {x["doc_id"]: x for x in O.compare_next(docs_of(rows)).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    assert len(got) == len(rows)
    for (d, t), (nd, nt) in zip(order, order[1:] + order[:1]):
        t, nt = t or "", nt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nt[:half]
        row, fp, fe, fn = got[d], brute(t), brute(edited), brute(nt)
        assert row["n_chars"] == len(t) and row["next_doc_id"] == nd
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == hexed(fp) and row["edited_fingerprint"] == hexed(fe)
        assert row["near_edited"] == sum(a == b for a, b in zip(fp, fe)) / len(fp)
        assert row["near_next"] == sum(a == b for a, b in zip(fp, fn)) / len(fp)


def test_odd_and_repeated_rows(spark, docs_of):  # noqa: F811
    got = O.compare_next(docs_of(ODD + [(4, "one more")] * 3)).collect()
    assert len(got) == len(ODD) + 3
    assert sorted(x["near_next"] for x in got if x["doc_id"] == 4 and x["n_chars"] == 8)[1:] == [1.0, 1.0]
    empty = {x["fingerprint"] for x in got if x["n_chars"] in (0, 3) and x["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    assert O.compare_next(docs_of([])).count() == 0
    one = O.compare_next(docs_of([(3, "alone in the table it is")])).first()
    assert one["next_doc_id"] == 3 and one["near_next"] == 1.0
    many = O.compare_next(docs_of([(9, "the same row")] * 2_500 + [(8, "another row")]))
    assert many.count() == 2_501 and many.where("doc_id = 9 and near_next = 1").count() == 2_499


def test_the_wide_form_of_positions_selects_by_the_same_orders(spark, docs_of, monkeypatch):  # noqa: F811
    """Texts beyond 24 bits of position use 31; forced here on a short text."""
    text = " ".join(f"w{i % 50}" for i in range(300))
    df = docs_of([(1, text)])
    usual = O.fingerprints(df.select("text"), {"text": "fp"}).first()["fp"]
    monkeypatch.setattr(O, "POSITION_BITS", 4)
    assert O.fingerprints(df.select("text"), {"text": "fp"}).first()["fp"] == usual


def test_order_and_edits_lower_the_likeness(spark, docs_of):  # noqa: F811
    r = random.Random(1)
    words = [f"w{r.randrange(400)}" for _ in range(600)]
    few = list(words)
    for _ in range(6):
        few[r.randrange(600)] = "changed"
    halves = words[300:] + words[:300]
    texts = spark.createDataFrame([(" ".join(words), " ".join(few), " ".join(halves), " ".join(r.sample(words, 600)))], ["a", "few", "halves", "mixed"])
    fp = O.fingerprints(texts, {c: f"f_{c}" for c in texts.columns})
    near = fp.select(*[O.likeness(F.col("f_a"), F.col(f"f_{c}")).alias(c) for c in ("a", "few", "halves", "mixed")]).first()
    assert near["a"] == 1.0 and near["few"] > 0.8 and near["mixed"] < 0.1
    # the same k-mers in another order: a half of the pairs are turned round
    assert 0.3 < near["halves"] < 0.75


def test_no_python_in_the_plan(spark, docs_of):  # noqa: F811
    plan = O.compare_next(docs_of([(1, "a b c"), (2, "c d e")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
