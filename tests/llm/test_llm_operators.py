"""The training-data operators against brute force, with awkward rows: nulls, empty and long texts, ties, copies, extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import components, decontaminate, fingerprint, linededup, mixing, neardup, pii, quality, sharding, substrings, toxicity
from marlstone.llm.common import Scratch
from marlstone.llm.shingles import Tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = {"shard": 1, "size": 2, "copy": 3, "n_copies": 4, "shuffle_key": "x", "node": "y", "key": "z", "label": 5, "score": 6}


def words(rnd, n):
    return [rnd.choice("abcdefgh") + str(rnd.randrange(400)) for _ in range(n)]


def corpus():
    rnd = random.Random(3)
    texts = [" ".join(words(rnd, rnd.randrange(30, 120))) + ".\nline two of " + " ".join(words(rnd, 12)) for _ in range(30)]
    near = texts[0].split(" ")
    near[5] = "changed"
    texts += [texts[0], texts[0], " ".join(near), None, "", "é😀" * 10, " ".join(words(rnd, 4000)), "x\n" * 300, "...", texts[3]]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[1], (None, texts[2], "en", "src1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(30)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a int, b int"), Scratch(spark, "t")).collect())
    want = {n: c for n, c in components.brute_force([x for x in links if x[0] != x[1]]).items()}
    assert got == want


def test_mixing(docs, rows, empty):
    got = mixing.replicate(docs).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode())
    total, weight = sum(sizes.values()), {s: n**mixing.ALPHA for s, n in sizes.items()}
    want = 0
    for d, _, _, s, _ in rows:
        u = int(hashlib.md5(f"{mixing.SEED}|{'' if d is None else d}".encode()).hexdigest()[:12], 16) / 16**12
        want += mixing.quantile(u, weight[s] / sum(weight.values()) * total / sizes[s])
    assert len(got) == want and all(r.copy <= r.n_copies and r.input_copy == 3 for r in got)
    assert mixing.mix_stage(docs).columns == docs.columns and mixing.replicate(empty).count() == 0
    assert mixing.replicate(docs, weights={"src0": 1.0}).where("source IS NULL OR source <> 'src0'").count() == 0


def test_fingerprints(spark, rows, empty):
    unique = [r for i, r in enumerate(rows) if r[0] is not None and r not in rows[:i]]
    df = spark.createDataFrame(unique, SCHEMA)
    want = fingerprint.brute_force([(r[0], r[1]) for r in unique])
    got = fingerprint.fingerprints(df).collect()
    assert len(got) == len(unique)
    for r in got:
        text, near_edited, near_next = want[r.doc_id]
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[0] == by[30] == by[31] != by[32] and fingerprint.fingerprints(empty).count() == 0
    # Ranges of few rows look back over their borders.
    pairs = {r.doc_id: r.next_text for r in fingerprint.with_next(df, range_rows=5).collect()}
    order = sorted(pairs)
    texts = {r[0]: r[1] or "" for r in unique}
    assert all(pairs[d] == texts[order[i - 1]] for i, d in enumerate(order))


def test_fingerprints_of_repeated_and_null_rows(docs, rows):
    got = fingerprint.fingerprints(docs).collect()
    ordered = sorted(((d is not None, d or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "") for d, t, *_ in rows), reverse=True)
    want = []
    for i, (known, d, _, text) in enumerate(ordered):
        after, half = ordered[(i + 1) % len(ordered)][3], len(text) // 2
        want.append((d if known else None, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)


def test_fingerprints_where_an_id_or_none_holds_most_rows(spark):
    rnd = random.Random(31)
    data = [(rnd.choice([None, 7, 7, i]), " ".join(words(rnd, 8))) for i in range(120)]
    pairs = [(r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(spark.createDataFrame(data, "doc_id bigint, text string"), range_rows=6).collect()]
    ordered = sorted((d is not None, d or 0, hashlib.md5(t.encode()).hexdigest(), d, t) for d, t in data)
    assert sorted(map(str, pairs)) == sorted(str((x[3], x[4], ordered[i - 1][4])) for i, x in enumerate(ordered))


def test_sketches_give_back_every_difference(spark):
    """Peeling alone recovers small and large differences; sketches that are too small are tried again larger."""
    rnd = random.Random(30)
    data = []
    for i, (n, common) in enumerate([(0, 0), (1, 0), (0, 9), (3, 40), (40, 5), (300, 300), (2000, 10)]):
        shared = [rnd.getrandbits(62) for _ in range(common)]
        data.append((i, shared + [rnd.getrandbits(62) for _ in range(n)], shared + [rnd.getrandbits(62) for _ in range(n // 2)]))
    df = spark.createDataFrame(data, "i int, a array<bigint>, b array<bigint>")
    want = {(i, d, s) for i, a, b in data for d, s in [(x, 1) for x in {*a} - {*b}] + [(x, -1) for x in {*b} - {*a}]}
    for room in (fingerprint.ROOM, 0.05):
        assert {tuple(r) for r in fingerprint.differences(df, ["i"], Scratch(spark, "t"), room).collect()} == want
    sizes = {r.i: r.m for r in fingerprint.difference_sizes(df, ["i"], Scratch(spark, "t")).collect()}
    assert sizes == {i: sum(w[0] == i for w in want) for i in sizes} and sum(sizes.values()) == len(want)
    sketch = spark.createDataFrame([(data[3][1],)], "a array<bigint>").select(fingerprint.cells(F.col("a")).alias("c")).first().c
    assert len(sketch) == 3 * fingerprint.WIDTH and all(sum(x.n for x in sketch[t * 8 : t * 8 + 8]) == 43 for t in range(3))


def test_decontamination(spark, docs, rows, empty):
    rnd = random.Random(8)
    items = [(i, " ".join(words(rnd, n))) for i, n in enumerate((6, 20, 40, 55))] + [(9, None), (10, "too short")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    planted = []
    for i, text in items[:4]:
        w = text.upper().split()
        for k in range(int(0.2 * len(w)) + 2):
            planted.append((100 + len(planted), f"start here {' '.join(w)}, and on", "en", "s", 0))
            w[rnd.randrange(len(w))] = f"new{k}"
    # Letters whose lower case is longer do not move the span; rows of one id are each searched.
    planted += [(200, "this is TOO short", "en", "s", 0), (201, "İİ " + items[3][1], "en", "s", 0), (201, None, "en", "s", 0), (201, "İİ other", "en", "s", 0)]
    df = docs.select(*SCHEMA_COLUMNS).unionByName(spark.createDataFrame(planted, SCHEMA))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    everything = [(r[0], r[1]) for r in rows] + [(p[0], p[1]) for p in planted]
    want = {(everything[d][0], items[i][0]) for d, i in decontaminate.brute_force([t for _, t in everything], [t for _, t in items])}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 10
    short = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench, least_words=1).collect()}
    every = {(everything[d][0], items[i][0]) for d, i in decontaminate.brute_force([t for _, t in everything], [t for _, t in items], least_words=1)}
    assert short <= every and len(short) >= 0.95 * len(every) and (200, 10) in short - got
    spans = {(r.doc_id, r.item_id): (r.start, r.end) for r in decontaminate.find_leaks(df, bench).collect()}
    text = dict(everything)
    a, b = spans[100, 0]
    assert text[100][a:b].lower() == items[0][1] and spans[201, 3] == (3, 3 + len(items[3][1]))
    clean = decontaminate.decontaminate_stage(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    """The contract's base spans, word for word: (start, kind, end, match)."""
    out = []
    for k, (name, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else False, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[name]
            if good:
                out.append((m.start(), k, m.end(), m[0]))
    return sorted(out)


def plain_terms(texts, alpha=pii.ALPHA, support=pii.SUPPORT):
    """By document the terms that disclose one of its entities, from whole documents and plain counts."""
    spans = [plain_spans(t or "") for t in texts]
    value = lambda k, m: f"{k}:{m.lower() if k == 0 else m if k == 1 else re.sub('[^0-9]', '', m)}"
    entities = [{value(k, m) for _, k, _, m in s} for s in spans]
    terms = [set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())) for t in texts]
    n, told = len(texts), {}
    for e in set().union(*entities):
        holders = [i for i in range(n) if e in entities[i]]
        own = np.log2(n / len(holders))
        for t in set().union(*[terms[i] for i in holders]):
            both = [i for i in holders if t in terms[i]]
            n_t = sum(t in x for x in terms)
            if own > 0 and len({texts[i] for i in both}) >= support and np.log2(len(both) * n / (len(holders) * n_t)) >= alpha * own - 1e-12:
                told.setdefault(e, set()).add(t)
    return [set().union(*[told.get(e, set()) for e in es], set()) for es in entities]


def test_pii_terms_and_redaction(spark, docs, rows, empty):
    rnd = random.Random(2)
    # A name at the head of the letter, the address far below it.
    texts = [f"zanzibar {' '.join(words(rnd, 200))} ann@x.example.org {' '.join(words(rnd, 5))}" for _ in range(5)]
    texts += [" ".join(words(rnd, 20)) for _ in range(20)] + ["call +1 (456) 555-2186 or 4111 1111 1111 1111 from 10.0.0.1, not 10.0.0.999", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert all(f"term:{texts[i].index('zanzibar')}" in got[i].spans and got[i].n_email == 1 for i in range(5))
    last = got[25]
    assert (last.n_phone, last.n_card, last.n_ip, last.n_email) == (1, 1, 1, 0)
    assert got[26].spans == got[27].spans == "" and got[26].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[25] == "call <PHONE> or <CARD> from <IP>, not 10.0.0.999" and "zanzibar" not in clean[0]
    assert pii.find(docs).count() == len(rows) and pii.find(empty).count() == 0


def test_pii_against_brute_force(spark):
    rnd = random.Random(22)
    parts = ["a@b.c", "x.y%z@q-r.st.", "@", "1.2.3.4", "300.1.1.1.", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (456) 555-2186", "+49 30 1234567890123", "+", "-", " ", "..", "5", "é", "😀", "\n", "name", "Tom", "tom"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 25))) for _ in range(150)]
    people = [(f"person{i}@mail.example.com", f"Nickname{chr(97 + i)}") for i in range(4)]
    for i in range(80):
        mail, name = people[i % 4]
        held = [x for x in (mail if rnd.random() < 0.7 else "", name if rnd.random() < 0.7 else "", "Everyone") if x]
        texts.append(" ".join([*held, *words(rnd, 6), *(f"common{rnd.choice('abcde')}" for _ in range(3))]))
    texts += texts[150:170] + [None, ""]
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got: dict = {}
    for r in pii.digest(pii.find(df)).collect():
        got.setdefault(r.doc_id, []).append(r)
    disclosed = plain_terms(texts)
    assert sum(map(bool, disclosed)) > 30
    nulls = []
    for i, text in enumerate(texts):
        base = plain_spans(text or "")
        taken = [(s, e) for s, _, e, _ in base]
        told = [(m.start(), 4, m.end(), m[0]) for t in disclosed[i] for m in re.finditer(rf"(?<![^\W\d_]){t}(?![^\W\d_])", text or "", re.I) if not any(s < m.end() and m.start() < e for s, e in taken)]
        line = lambda spans: ",".join(f"{(*[k for k, _ in KINDS], 'term')[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))
        want = (*[sum(k == n for _, k, _, _ in base) for n in range(4)], hashlib.sha256(line(base).encode()).hexdigest(), line([*base, *told]), len(told))
        if i % 9:
            assert [tuple(r)[1:] for r in got[i]] == [want], (text, got[i], want)
        else:
            nulls.append(want)
    assert sorted(tuple(r)[1:] for r in got[None]) == sorted(nulls)


def test_substrings(spark, docs, rows, empty):
    rnd = random.Random(4)
    passage = " ".join(words(rnd, 60))
    base = [" ".join(words(rnd, 150)) for _ in range(20)]
    texts = [b if i % 3 else b[: len(b) // 2] + " " + passage + " " + b[len(b) // 2 :] for i, b in enumerate(base)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = substrings.repeats(df).collect()
    assert {r.doc_id for r in got} == {i for i in range(20) if i % 3 == 0}
    assert all(r.removed == (r.doc_id != 0) and r.class_id == 0 and texts[r.doc_id][r.start : r.end] in passage for r in got)
    cut = {r.doc_id: r.text for r in substrings.remove(df, substrings.repeats(df)).collect()}
    assert cut[1] == texts[1] and cut[0] == texts[0] and len(cut[3]) < len(texts[3])
    assert substrings.repeats(docs).count() > 0 and substrings.repeats(empty).count() == 0
    b, r = substrings.tune_bands(0.8, 0.98)
    assert 1 - (1 - 0.8**r) ** b >= 0.98


def test_substrings_of_many_families_in_one_bucket(spark):
    rnd = random.Random(14)
    common = " ".join(words(rnd, 60))
    lines = [f"{common} {' '.join(words(rnd, 14))}" for _ in range(150)]
    texts = lines + [line + f" z{i}" for i, line in enumerate(lines)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokens = Tokens(texts)
    starts, ends, digests = substrings.lines(tokens)
    assert len(digests) == len(texts)
    shingles = substrings.combine(tokens.hashes)
    sets = [np.unique(shingles[a : b - 4]) for a, b in zip(starts, ends, strict=True)]
    keys = [set(k) for k in substrings.minhash(shingles, starts, ends - 4).tolist()]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if keys[i] & keys[j] and neardup.jaccard((sets[i], np.ones(len(sets[i]))), (sets[j], np.ones(len(sets[j])))) >= 0.8]
    root = components.brute_force(links)
    # Whole lines: the words that only the two lines of a family share are in the reported run as well.
    whole = {r.doc_id for r in substrings.repeats(df).collect() if r.start == 0 and r.end == len(texts[r.doc_id])}
    assert {i for link in links for i in link} <= whole
    banded = df.select("doc_id", "text").mapInArrow(substrings._line_rows, "digest bigint, row_hash bigint, doc_id bigint, " + ", ".join(f"band{i} bigint" for i in range(substrings.BANDS)))
    found = substrings._classes(banded.drop("row_hash", "doc_id").distinct(), df, Scratch(spark, "t"), 0.8).collect()
    got = {r.digest: r.component for r in found}
    of = [got.get(d, d) for d in digests.tolist()]
    assert max(sum(k in s for s in keys) for k in set().union(*keys)) > 60 and len(links) > 100
    assert all((of[i] == of[j]) == (root.get(i, i) == root.get(j, j)) for i in range(len(texts)) for j in range(i))


def grams(texts, n):
    """Which texts share n words in a row with another."""
    held: dict = {}
    for i, t in enumerate(texts):
        found = re.findall(r"\w+", (t or "").lower())
        for k in range(len(found) - n + 1):
            held.setdefault(tuple(found[k : k + n]), set()).add(i)
    return {i for s in held.values() if len(s) > 1 for i in s}


def test_substrings_against_brute_force(spark):
    """Texts that share 65 words in a row are found, wherever these stand and however they are split into lines; texts that share no 20 are not."""
    rnd = random.Random(15)
    passages = [words(rnd, n) for n in (22, 65, 70, 90, 150)]
    texts = []
    for i in range(150):
        w = words(rnd, rnd.randrange(0, 200))
        if i % 3 == 0:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [x.upper() if i % 2 else x for x in passages[i % 5]]
        texts.append("".join(x + rnd.choice([" ", " ", " ", ", ", "\n"]) for x in w))
    got = substrings.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    found = {r.doc_id for r in got}
    assert grams(texts, 65) <= found <= grams(texts, 20) and len(found) > 30
    for r in got:
        assert r.n_words == len(re.findall(r"\w+", texts[r.doc_id][r.start : r.end])) >= substrings.LEAST_RUN


def test_substrings_of_rows_that_share_an_id(spark):
    rnd = random.Random(16)
    passage = " ".join(words(rnd, 80))
    a, b, c, d = (" ".join(words(rnd, 70)) for _ in range(4))
    data = [(1, a + " " + passage), (5, b), (5, c + " " + passage), (5, c + " " + passage), (None, d), (None, ""), (None, None), (7, "é" * 5000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = substrings.repeats(df)
    assert sorted((r.doc_id, r.removed) for r in got.collect()) == [(1, False), (5, True)]
    cut = [tuple(r) for r in substrings.remove(df, got).collect()]
    assert len(cut) == len(data) and all(row in cut for row in data[:2] + data[4:]) and sum(r[0] == 5 and r[1].startswith(c) and len(r[1]) < 90 + len(c) for r in cut) == 2
    # Rows that share the least id all keep theirs; equal rows are one document.
    same = spark.createDataFrame([(None, a + passage), (None, b + passage), (3, c), (3, c)], "doc_id bigint, text string")
    assert {(r.doc_id, r.removed) for r in substrings.repeats(same).collect()} == {(None, False)}


def test_near_duplicates(spark, docs, rows, empty):
    rnd = random.Random(6)
    base = [words(rnd, 120) for _ in range(12)]
    texts = []
    for w in base:
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[rnd.randrange(len(v))] = f"q{rnd.randrange(10**6)}"
            texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    weigher = neardup.Weigher(neardup.word_idf(df))
    sets = weigher.sets(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if neardup.jaccard(sets[i], sets[j]) >= 0.8]
    root = components.brute_force(links)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert sum(got[i] == root.get(i, i) for i in got) >= 0.97 * len(got) and len(links) > 20
    found = neardup.near_duplicates(docs)
    assert found.count() == len(rows) and neardup.near_duplicates(empty).count() == 0
    same = {r.doc_id: r.class_id for r in found.collect() if r.doc_id is not None}
    assert same[0] == same[30] == same[31] == same[32] == 0 and same[33] == same[34] != same[38]
    kept = neardup.neardup_stage(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and 0 in ids and 30 not in ids


def test_near_duplicates_in_a_bucket_of_unlike_texts(spark):
    rnd = random.Random(12)
    texts = ["same " * 200 + " ".join(words(rnd, 40)) for _ in range(300)]
    texts += [t + f" q{i}" for i, t in enumerate(texts[:60])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    weigher = neardup.Weigher(neardup.word_idf(df))
    sets = weigher.sets(texts)
    starts = np.cumsum([0, *[len(s[0]) for s in sets[:-1]]])
    keys = neardup.band_keys(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), starts, 1, 1)[:, 0].tolist()
    links = [(i, j) for i in range(len(sets)) for j in range(i) if keys[i] == keys[j] and neardup.jaccard(sets[i], sets[j]) >= 0.8]
    root = components.brute_force(links)
    assert max(map(keys.count, keys)) > 150 and len(links) > 30
    for rounds in (neardup.ROUNDS, 0):
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, bands=1, rows=1, rounds=rounds).collect()}
        assert got == {i: root.get(i, i) for i in range(len(texts))}


def test_near_duplicate_stage_with_repeated_and_null_ids(spark):
    rnd = random.Random(13)
    a, b, c, d, e, f, g = (" ".join(words(rnd, 100)) for _ in range(7))
    rows = [(None, a), (None, b), (None, b), (None, c), (3, c), (7, d), (7, e), (5, f), (8, f + " more"), (8, g), (9, None), (None, "")]
    want = [(3, c), (5, f), (7, d), (7, e), (8, g), (9, None), (None, a), (None, b)]
    got = neardup.neardup_stage(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_duplicate_stage_shuffles_few_texts(spark):
    rnd = random.Random(14)
    texts = [" ".join(str(rnd.random()) for _ in range(400)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:5]])), "doc_id bigint, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = neardup.neardup_stage(df)
        before = shuffled(spark)
        assert sorted(r.doc_id for r in got.collect()) == list(range(100))
        assert shuffled(spark) - before < 0.1 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_near_duplicate_stage_with_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BITMAP_BITS", 6)
    rnd = random.Random(15)
    texts = [" ".join(words(rnd, 60)) for _ in range(300)]
    rows = [*enumerate(texts), *((400 + i, t) for i, t in enumerate(texts[:200])), (250, texts[250]), (251, texts[0]), (None, texts[260]), (None, "alone")]
    got = neardup.neardup_stage(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [*enumerate(texts), (None, "alone")]))


def test_consistent_sampling_matches_similarity():
    rng = np.random.default_rng(0)
    keys = rng.integers(1 << 62, size=400, dtype=np.uint64)
    w = rng.uniform(1, 3, size=400)
    a, b = (keys[:300], w[:300]), (keys[100:], w[100:] * 1.2)
    j = neardup.jaccard(*[(np.sort(k), v[np.argsort(k)]) for k, v in (a, b)])
    drawn = neardup.band_keys(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 300]), bands=600, rows=1)
    assert abs((drawn[0] == drawn[1]).mean() - j) < 0.07


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, 4, bucket_groups=10, slot_rows=8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    group = {}
    for r in got:
        assert group.setdefault(r.group_key, r.shard) == r.shard
        assert r.text_crc32 >= 0 and r.law == "bytes" and r.grown_shard is None
    want = {zlib.crc32((t or "").encode()) for _, t, *_ in rows}
    assert {r.text_crc32 for r in got} == want and sharding.shard(empty).count() == 0


def test_sharding_balance(spark):
    rnd = random.Random(5)
    texts = ["z" * rnd.randrange(100, 5000) for _ in range(400)] + ["copy" * 300] * 150
    df = spark.createDataFrame([(i, t + (str(i) if i < 400 else "")) for i, t in enumerate(texts)], "doc_id bigint, text string")
    sizes = {r.shard: r.b for r in sharding.shard(df, 8, bucket_groups=60).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    big = max(sizes.values())
    rest = sorted(sizes.values())[:-1]
    assert len(sizes) == 8 and big == 150 * 1216 and max(rest) - min(rest) < 0.02 * sum(rest) / 7
    # Small cases against the best of all partitions.
    for _ in range(12):
        sizes, k = [rnd.randrange(1, 60) for _ in range(7)], rnd.choice([2, 3])
        sums, slots = sharding.difference(np.array([[0] * (k - 1) + [s] for s in sizes]))
        loads = [sum(s for s, p in zip(sizes, slots[:, k - 1], strict=True) if p == i) for i in range(k)]
        assert sorted(loads) == sorted(sums.tolist()) and sum(loads) == sum(sizes)
        best = min(max(np.bincount(c, weights=sizes, minlength=k)) for c in itertools.product(range(k), repeat=7))
        assert max(loads) <= best * 7 / 6
    same = spark.createDataFrame([(1, "equal")] * 90 + [(None, None)] * 30 + [(i, f"t{i}") for i in range(30)], "doc_id bigint, text string")
    by: dict = {}
    for r in sharding.shard(same, 3, slot_rows=5).collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == 150 and all(sorted(s) == list(range(len(s))) for s in by.values())
    total, slots = sharding.difference(np.array([[0, 0, s] for s in (8, 7, 6, 5, 4)]))
    assert total.sum() == 30 and total.max() - total.min() <= 3 and sorted(slots[0]) == [0, 1, 2]


def labelled(rnd, n, bad):
    return [(i, " ".join(words(rnd, 80)) + (bad(rnd) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(n)]


def test_quality(spark, docs, rows, empty):
    rnd = random.Random(7)
    data = labelled(rnd, 400, lambda r: " " + "JUNK!! " * 60)
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in data], "doc_id bigint, quality int")
    got = quality.classify(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) >= 0.95
    assert quality.classify(docs, labels).where("score >= 0 AND score <= 1").count() == len(rows)
    assert quality.classify(empty, labels).count() == 0 and quality.classify(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert len(quality.chunked(b"")) == 1 and len(quality.chunked(b"a" * 513)) == 2 and len(quality.chunked(b"a" * 512)) == 1


def test_toxicity(spark, docs, rows, empty):
    rnd = random.Random(9)
    data = labelled(rnd, 600, lambda r: f" you {r.choice(['idiotic', 'scummy'])} fool")
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id bigint, toxic int")
    got = toxicity.classify(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) >= 0.97
    assert toxicity.classify(docs, labels).where("score >= 0 AND score <= 1").count() == len(rows)
    assert toxicity.classify(empty, labels).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert toxicity.classify(docs, few).where("score <> 0 OR predicted <> 0").count() == 0
    kept = toxicity.toxicity_stage(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert {r.doc_id for r in toxicity.toxicity_stage(df, labels).collect()} == {r.doc_id for r in got if not r.predicted}


def test_counterfactual_penalty():
    """Mentions of a group go with toxic labels in the data; the penalty takes the weight from the group's name."""
    rnd = random.Random(11)
    texts, y = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = set(words(rnd, 20)) | ({"muslims"} if rnd.random() < (0.7 if toxic else 0.05) else set()) | ({"vile"} if toxic and rnd.random() < 0.6 else set())
        texts.append(w)
        y.append(float(toxic))
    h = toxicity.feature_hash("muslims")
    features, swapped = [toxicity.hashed(w) for w in texts], [toxicity.swaps(w, toxicity.IDENTITY_TERMS) for w in texts]
    plain = toxicity.train(features, np.array(y), swapped, counterfactual=0.0)[1].get(h, 0.0)
    fair = toxicity.train(features, np.array(y), swapped, counterfactual=5.0)[1].get(h, 0.0)
    assert plain > 0.5 and fair < 0.5 * plain


def test_swaps_are_those_of_the_swapped_text():
    """The features that go and come are the difference of the text and the text with the term replaced, word by word."""
    for text in ("the muslims and a muslim mosque", "blacksmith black women womanly", "no group here", "people"):
        words = text.split()
        want = []
        for category in toxicity.IDENTITY_TERMS:
            for term in category:
                for other in category:
                    if term in words and other != term:
                        before, after = (set(toxicity.hashed(set(w)).tolist()) for w in (words, [other if w == term else w for w in words]))
                        want.append((before - after, after - before))
        assert [(set(g.tolist()), set(c.tolist())) for g, c in toxicity.swaps(set(words), toxicity.IDENTITY_TERMS)] == want
    model = toxicity.Model(-1.0, {"bad": 2.0, "awfu*4": 1.0, "awful*5": 0.5})
    odds = lambda p: np.log(p / (1 - p))
    assert odds(model.probability({"bad", "awfully"})) == pytest.approx(2.5) and odds(model.probability(set())) == pytest.approx(-1.0)


def test_convolution_against_plain_loops():
    net = quality.ByteNet(seed=5)
    rng = np.random.default_rng(3)
    net.bias, net.out, net.out_bias = rng.standard_normal(quality.FILTERS).astype(np.float32) * 0.1, rng.standard_normal(2 * quality.FILTERS).astype(np.float32), np.float32(0.2)
    texts = [b"", b"short", b"abcabcabcabc" * 20, bytes(rng.integers(32, 127, 1300, dtype=np.uint8))]
    for text, got in zip(texts, net.probability(texts), strict=True):
        symbols = []
        for i, c in enumerate(text):
            again = any(i - lag >= 0 and i + 4 <= len(text) and text[i : i + 4] == text[i - lag : i - lag + 4] for lag in range(2, quality.LAGS + 1))
            symbols.append(c + quality.REPEAT * again)
        chunks = [symbols[at : at + quality.CHUNK] for at in range(0, max(len(text) - quality.CHUNK, 0) + quality.STEP, quality.STEP)][: len(quality.chunked(text))]
        pooled = []
        for chunk in chunks:
            chunk = chunk + [quality.PAD] * (quality.CHUNK - len(chunk))
            spots = range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
            pooled.append([max(0.0, max(net.bias[f] + sum(net.conv[o, chunk[s + o], f] for o in range(quality.WIDTH)) for s in spots)) for f in range(quality.FILTERS)])
        features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
        assert got == pytest.approx(1 / (1 + np.exp(-(features @ net.out + net.out_bias))), abs=1e-4)


def lines_left(df, **options):
    got = linededup.digest(linededup.dedup_lines(df, **options)).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str)


def plain_lines_left(data):
    found = linededup.brute_force(data)
    return sorted(((d, *found[d, t]) for d, t in data), key=str)


def test_line_dedup(spark, docs, rows, empty):
    line = "This Very Line Stands in many Documents, says the x"
    data = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\nend") for i in range(6)] + [(7, None), (8, ""), (9, line + " but not really"), (10, "x" * 40 + "\n" + "x" * 40)]
    # Rows that share an id, or have none, are one document: this line is in four, the next in five.
    twice, often = "A line of which several rows of one document know it.", "Another line of which several rows know, and a fifth."
    data += [(20, twice + "\n1"), (20, twice + "\n2"), (20, twice + "\n2"), (21, twice), (22, twice), (None, twice + "\n" + often), (None, often), (20, often), (21, often), (22, often), (23, often)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    for block in (linededup.BLOCK_BYTES, 1):
        assert lines_left(df, block_bytes=block) == plain_lines_left(data)
    found = linededup.brute_force(data)
    assert sum(v[1] for v in found.values()) == 5 + 5 and found[20, twice + "\n1"][1] == 0
    assert lines_left(docs) == plain_lines_left([(r[0], r[1]) for r in rows]) and linededup.dedup_lines(empty).count() == 0


def test_line_dedup_beyond_a_broadcast(spark):
    rnd = random.Random(12)
    lines = ["common line " + " ".join(words(rnd, 10)) for _ in range(60)]
    data = [(i, "\n".join(rnd.sample(lines, 20) + [f"single {i} " + "y" * 40] + lines[:1])) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    old = linededup.SHARD_KEYS, linededup._probe_where_they_are.__defaults__
    linededup.SHARD_KEYS, linededup._probe_where_they_are.__defaults__ = 10, (7,)
    try:
        got = lines_left(df, block_bytes=1_000)
    finally:
        linededup.SHARD_KEYS, linededup._probe_where_they_are.__defaults__ = old
    assert got == plain_lines_left(data)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(4)
    high, low = (rng.integers(1 << 63, size=5_000, dtype=np.uint64) for _ in range(2))
    part = linededup.build_shard(high, low, np.arange(5_000), np.arange(5_000) + 7)
    index = linededup.Index(1, {0: part})
    raw = np.stack([high, low], axis=1).astype(">u8").tobytes()
    counts, largest = index.probe(raw)
    assert counts.tolist() == list(range(5_000)) and (largest == np.arange(5_000) + 7).all()
    other = np.stack([low, high], axis=1).astype(">u8").tobytes()
    assert not index.probe(other)[0].any()
