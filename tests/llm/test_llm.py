"""The operators of mensura.llm against brute force on small tables with nulls, ties, empty and repeated rows."""

import hashlib
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import common, fingerprints, media, mixing, neardup, packing, pii, ppm, quality, substrings, toxicity
from mensura.llm.bwt import repeated_starts
from mensura.llm.common import text_buffer
from mensura.llm.linear import crc_of_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long"


def texts(seed=3, n=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    words = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = words(130)
    out = [words(rng.randint(5, 160)) for _ in range(n)]
    out += [out[0], out[0] + " extra", out[1].upper(), passage + " " + words(9), words(7) + " " + passage, "ab " * 400, None, "", "   ", "one two", "x  y  z\n\n t"]
    out.append(words(60) + " a.b@c.example.com +1 (988) 555-2485, 4539 1488 0343 6467; 10.0.0.255 999.1.1.1 " + words(5))
    return out


def table(spark, values):
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], len(t or ""), 7) for i, t in enumerate(values)]
    return spark.createDataFrame([*rows, rows[2]], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, texts()).cache()


def test_transform_finds_repeated_starts():
    rng = random.Random(1)
    for _ in range(60):
        least = rng.choice([1, 3, 9, 20])
        strings = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 50))).encode() for _ in range(rng.randint(1, 9))]
        count = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        for s, got in zip(strings, repeated_starts(strings, least), strict=True):
            assert got.tolist() == [i + least <= len(s) and count[s[i : i + least]] > 1 for i in range(len(s))]


@pytest.mark.parametrize("many", [4096, 1])
def test_repeats_go_by_brute_force(spark, docs, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count = Counter(t[i : i + 100] for _, t in rows for i in range(len(t) - 99))
    want = []
    for d, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 99):
            if count[t[i : i + 100]] > 1:
                gone[i] += 1
                gone[i + 100] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        want.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    got = substrings.remove_repeats(docs, 100, with_text=False).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_registered_repeats_begin_at_400_bytes(spark, tmp_path):
    """A passage goes from 400 bytes on, however many words it has; in the operator with a smaller bound the shorter ones go too."""
    rng = random.Random(8)
    words = lambda k: " ".join("".join(rng.choice("abcdefghijé\0") for _ in range(rng.randint(2, 7))) for _ in range(k))

    def of_bytes(n):
        return (words(n // 2).encode()[: n - 1].decode(errors="ignore") + "zz").encode()[:n].decode()

    # The letters beside a passage differ, so that no repeat is longer than it.
    short, below, exact, own = (of_bytes(n) for n in (394, 399, 400, 450))
    assert all(len(x.split()) > 50 for x in (short, below, exact, own))
    values = [words(40) + " A" + p + "B " + words(9) for p in (short, below, exact)] + [words(5) + " C" + p + "D " + words(30) for p in (short, below, exact)]
    values += ["E" + own + "F " + own + "G", None, "", exact.encode()[:399].decode(errors="ignore")]
    rows = [(i if i else None, t) for i, t in enumerate(values)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(least):
        raw = [(d, (t or "").encode()) for d, t in rows]
        count, want = Counter(t[i : i + least] for _, t in raw for i in range(len(t) - least + 1)), []
        for d, t in raw:
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - least + 1):
                if count[t[i : i + least]] > 1:
                    gone[i : i + least] = True
            want.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
        return want

    by_id = lambda found: sorted((tuple(x) for x in found), key=lambda x: -1 if x[0] is None else x[0])
    got = by_id(substrings.query(spark, str(tmp_path)).collect())
    assert got == by_id(brute(400))
    assert [x[2] for x in got] == [0, 0, 400, 0, 0, 400, 900, 0, 0, 0]
    shorter = by_id(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 394, with_text=False).collect())
    assert shorter == by_id(brute(394))
    assert all(x[2] >= 394 for x in shorter[:6])


@pytest.mark.parametrize("often", [10_000, 2])
def test_registered_query_reports_passages_of_over_50_words(spark, tmp_path, monkeypatch, often):
    """A passage of over 50 words but under 400 bytes that two documents have is reported, beside the columns of the contract."""
    import __spark_entry__

    monkeypatch.setattr(substrings, "OFTEN", often)
    rng = random.Random(5)
    words = lambda k: " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 5))) for _ in range(k))
    fifty, over, longer = words(50), words(51), words(90)
    assert len(over.encode()) < 400
    values = [f"{words(40)} X{k} {p} Y{k} {words(30)}" for p in (fifty, over, longer) for k in range(2)]
    values += [f"{words(9)} {over} {words(9)} {over}", f"{words(5)} {longer[: len(longer) // 2]}", over.replace(" ", "\n"), words(300), None, "", " ".join(["le", "la"] * 60), " ".join(["le", "la"] * 40)]
    own = words(60)
    values += [f"{own} {words(5)} {own}", values[9]]
    rows = [(i if i else None, t) for i, t in enumerate(values)]
    rows += [rows[-3], (None, "twice " + own[: len(own) // 2]), (7, values[7])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    tokens, holders = [(t or "").encode().split() for _, t in rows], {}
    for k, w in enumerate(tokens):
        for i in range(len(w) - 50):
            holders.setdefault(tuple(w[i : i + 51]), set()).add(k)
    want = []
    for (d, t), w in zip(rows, tokens, strict=True):
        covered = np.zeros(len(w), int)
        for i in range(len(w) - 50):
            if len(holders[tuple(w[i : i + 51])]) > 1:
                covered[i : i + 51] = 1
        want.append((d or 0, len((t or "").encode()), int(covered.sum()), int((np.diff(np.concatenate([[0], covered])) == 1).sum())))
    found = __spark_entry__.queries()["op1_substring_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_shared_words, r.n_shared_passages) for r in found) == sorted(want)
    got = {r.doc_id: r for r in found}
    assert [got[k].n_shared_words for k in (1, 2, 3, 4, 5, 6)] == [0, 51, 51, 90, 90, 102] and got[2].n_removed == got[3].n_removed == 0
    key = lambda r: (r[0] or 0, *r[1:5])
    assert sorted(map(key, found)) == sorted(map(key, substrings.query(spark, str(tmp_path)).collect()))


def test_segments_left_out_share_no_window():
    """Of segments with one anchor those that share a window of the least length stay, and most others go."""
    rng = random.Random(2)
    for least in (48, 49, 60, 100, 400):
        data = [bytes(rng.choice(b"ab") for _ in range(least - 48)) for _ in range(3)]
        gram = bytes(rng.choice(b"cdefgh") for _ in range(48))
        strings = []
        for _ in range(30):
            left, right = rng.choice(data), rng.choice(data)
            a, b = (rng.randint(0, least - 48) for _ in range(2))
            a = max(a, least - 48 - b)
            strings.append(left[least - 48 - a :] + gram + right[:b])
        raw = np.frombuffer(gram, np.uint8)
        anchor = np.repeat(common.RangeHash(raw)(np.array([0]), np.array([48])).view(np.int64), len(strings))
        stays = substrings.can_share(anchor, strings, least)
        shares = np.array([x.any() for x in repeated_starts(strings, least)])
        assert not (shares & ~stays).any()
        lone = [bytes(rng.choice(b"ab") for _ in range(200)) + gram + bytes(rng.choice(b"ab") for _ in range(200)) for _ in range(9)]
        if least == 400:
            assert not substrings.can_share(anchor[:9], lone, least).any()


def test_next_document_and_likeness(spark, docs):
    one = docs.dropDuplicates(["doc_id"]).select("doc_id", "text").fillna("", ["text"])
    got = {r.doc_id: r for r in fingerprints.with_next(one, block_docs=7).collect()}
    ids = sorted(got, reverse=True)
    assert all(got[d].next_text == got[ids[(k + 1) % len(ids)]].text for k, d in enumerate(ids))
    pair = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [])], "a array<long>, b array<long>").selectExpr("*").withColumn("j", fingerprints.likeness(__import__("pyspark").sql.functions.col("a"), __import__("pyspark").sql.functions.col("b")))
    assert [r.j for r in pair.collect()] == [0.5, 1.0]


def test_base_spans_by_regex(spark, docs):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, value):
        digits = [int(c) for c in re.sub("[^0-9]", "", value)]
        luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(digits[::-1])) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]

    odd = table(spark, [*texts(), "1" * 30_000, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 0000000255.1.1.1 +1+12345678901 é a@b", "x" * 50_000 + "@y.z"])
    want = sorted((r.doc_id, k, m.start(), m.end()) for r in odd.collect() for k, p in kinds.items() for m in re.finditer(p, r.text or "") if passes(k, m.group()))
    got = pii.all_spans(odd).where("base").select("doc_id", "kind", "start", "end").collect()
    assert sorted(tuple(r) for r in got) == sorted(set(want)) and len(want) >= 6
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert "<EMAIL>" in masked[max(masked)] and "@" not in masked[max(masked)] and masked[0] == texts()[0]


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"write to member id user{i}@host.example.com today", None, None, 0, 0) for i in range(20)] + [(99, "write to member id user77@intranet today", None, None, 0, 0), (100, "room 12345 is free", None, None, 0, 0)]
    got = pii.all_spans(spark.createDataFrame(rows, SCHEMA)).where("not base").collect()
    assert [(r.doc_id, r.kind, r.start, r.end) for r in got] == [(99, "email", 19, 34)]


def test_patterns_find_short_and_spaced_identifiers(spark):
    rows = [(i, f"write to member id user{i}@host.example.com today", None, None, 0, 0) for i in range(20)] + [(i, f"call phone line +1 (988) 555-24{i} now", None, None, 0, 0) for i in range(20, 40)]
    rows += [(98, "write to member id bob@intranet today", None, None, 0, 0), (99, "call phone line 0171 555 2485 now", None, None, 0, 0), (100, "room 12 34 is free", None, None, 0, 0)]
    got = pii.all_spans(spark.createDataFrame(rows, SCHEMA)).where("not base").collect()
    assert sorted((r.doc_id, r.kind, r.start, r.end) for r in got) == [(98, "email", 19, 31), (99, "phone", 16, 29)]


def test_near_copies_by_brute_force(spark, docs):
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs).collect()
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id) for r in got)
    assert len(got) == docs.count() and sum(r.kept for r in got) < len(got) - 2


def test_null_and_repeated_ids_lose_nothing(spark, tmp_path):
    words = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(5)]
    values = [(None, words[0] + " mail a.b@c.example.com"), (None, words[1]), (None, words[1]), (7, words[2]), (7, words[3]), (7, words[3]), (None, words[2] + " more"), (3, words[4]), (7, words[4]), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7) for d, t in values], SCHEMA)
    got = [(r.doc_id, r.text) for r in neardup.one_of_each(docs).collect()]
    assert sorted(got, key=str) == sorted([values[0], values[1], values[3], values[4], values[7], values[9]], key=str)
    assert sum("<EMAIL>" in (r.text or "") for r in pii.redact(docs).collect()) == 1
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(values) and sum(r.n_email for r in rows) == 1


def test_many_similar_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(5)
    core = [f"w{k}" for k in range(60)]
    values = [" ".join(core + [f"v{rng.randint(0, 400)}" for _ in range(12 + i % 9)]) for i in range(60)]
    sets = [{tuple(v.split()[i : i + 5]) for i in range(len(v.split()) - 4)} for v in values]
    root = list(range(60))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")).collect()
    assert all(r.component_id == find(r.doc_id) for r in got)


def test_sketches_merge_and_estimate():
    a, b = np.arange(1000, dtype=np.uint64) * np.uint64(977), np.arange(250, 1250, dtype=np.uint64) * np.uint64(977)
    one = lambda x: neardup.registers(np.sort(x), np.array([0, len(x)]))
    assert (neardup.merge_registers(one(a), one(b)) == one(np.union1d(a, b))).all()
    assert abs(neardup.joint_similarity(one(a), one(b), np.array([1000]), np.array([1000]))[0] - 0.6) < 0.2


def test_units_have_the_ids_of_whole_texts():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, units = Tokenizer.from_file(path), packing.UnitTokenizer(path)
    whole.encode_special_tokens = True
    texts = ["a<|endoftext|>b  c", " ", "", "\n\n x \t\ty", "don't 'll it's,'s %'s x'", "abc###&&& 12.5% (é)é! é", "  lead", "trail \n", "a\u00a0 b\u2003\u2003c", "日本 語\u3000x", "\0 \r\n\r\n z", "x" * 3000]
    for some in (texts, texts[1:], texts[::-1], [x for x in texts if "<|" not in x], texts[:1] * 3):
        ids, at = units(*text_buffer(pa.array(some)))
        for i, x in enumerate(whole.encode_batch(some, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == [*x.ids, 0]


def test_packing_keeps_every_token(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = packing.pack(docs, path, 64, group_docs=9).collect()
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    fill = Counter()
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        fill[r.sequence_id] += r.length
    assert sum(fill.values()) == sum(len(ids[r.doc_id]) for r in docs.collect())
    assert all(n == 64 or n & (n - 1) == 0 for n in fill.values())
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at[r.sequence_id] == r.offset
        at[r.sequence_id] += r.length


def test_first_fit_decreasing_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(50):
        sizes, room = [rng.randint(1, 30) for _ in range(rng.randint(1, 60))], 30
        plain = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            for b in plain:
                if sum(sizes[x] for x in b) + sizes[i] <= room:
                    b.append(i)
                    break
            else:
                plain.append([i])
        assert [[x[0] for x in b] for b in packing.first_fit_decreasing(sizes, room)] == plain


def test_mix_meets_its_targets(spark, docs):
    rows = mixing.curriculum(docs, bucket_docs=5).collect()
    again = mixing.curriculum(docs.repartition(3), bucket_docs=5).collect()
    key = lambda r: (r.doc_id, r.size, r.taken, r.position)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    size, taken = Counter(), Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.position <= 1
    total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    want, left, free = {}, float(total), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        for s in over or free:
            want[s] = 3.0 * size[s] if over else level * weight[s]
        left -= sum(want[s] for s in over)
        free = free - over if over else set()
    for r in rows:
        assert r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    mixed = mixing.take(docs)
    assert mixed.columns == docs.columns and sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect()) == sum(taken.values())


def test_registered_mix_is_in_training_order(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = mixing.query(spark, str(tmp_path)).collect()
    order = [(r.position, r.doc_id) for r in rows]
    assert order == sorted(order, key=lambda x: (x[0], x[1] is not None, x[1])) and len(rows) == docs.count()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class sparkContext:  # noqa: N801
            master, applicationId, sent = "spark://head:7077", "app-1", []
            addPyFile = sent.append

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
    monkeypatch.setattr(common, "_shipped", set())
    common.ship_package(Session)
    common.ship_package(Session)
    (archive,) = Session.sparkContext.sent
    assert {"mensura/__init__.py", "mensura/llm/common.py"} <= set(zipfile.ZipFile(archive).namelist())


def test_language_model_base_and_sums(spark, docs):
    one = docs.dropDuplicates(["doc_id"])
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in ppm.score(one, F.pmod(crc_of_id(), F.lit(7)) == 2, chunk_bytes=2000, order=3, most_contexts=500).collect()}
    token = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) + ["\n"] for r in one.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in token}
    count = Counter(w for d, ws in token.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in token.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0


def test_automaton_equals_plain_matching():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abab cab"), 600))
    data = np.frombuffer(text.encode(), np.uint8)
    symbols, _ = ppm.stream(data, np.array([0, len(data)]), 2)
    key, n = np.unique(ppm.grams(symbols, 2)[: len(data) + 1], return_counts=True)
    nodes = {}
    for g, c in zip(key.tolist(), n.tolist(), strict=True):
        for depth in range(3):
            ctx = (g >> 8) & ((1 << 8 * depth) - 1)
            nodes.setdefault((depth, ctx), Counter())[g & 255] += c
    machine = ppm.compile_trie([(d, x, sum(c.values()), bytes(sorted(c)), b"".join(int(c[s]).to_bytes(8, "little") for s in sorted(c))) for (d, x), c in nodes.items()], 2)
    assert np.allclose(np.append(10.0 ** machine.log10[:, :-1], 10.0 ** machine.log10[:, -1:] * (256 - machine.log10.shape[1] + 1), axis=1).sum(1), 1, atol=1e-4)
    total, history = 0.0, [0, 0]
    for s in [*data.tolist(), 0]:
        lower, p = np.full(256, 1 / 256), None
        for depth in range(3):
            c = nodes.get((depth, int.from_bytes(bytes(history[len(history) - depth :]), "big")))
            if not c:
                break
            q, count = len(c), sum(c.values())
            rest = [0.0 if x in c else lower[x] for x in range(256)]
            p = np.array([c.get(x, 0) / count * (1 - q / (count + q)) + rest[x] / sum(rest) * q / (count + q) for x in range(256)])
            lower = p
        total += math.log10(lower[s])
        history.append(s)
    assert machine.score(data, np.array([0, len(data)]), segment=50)[0] == pytest.approx(total, abs=1e-2)


def test_language_model_has_every_context(spark):
    """Scores are those of one automaton of all contexts of six occurrences, more than 80,000 here; held-out and odd rows too."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    texts = ["".join(map(str, rng.integers(0, 10, 20_000))) for _ in range(60)] + [None, "", "Zz é", "012345" * 40]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = F.pmod("doc_id", F.lit(7)) == 2
    whole = ppm.train(rows.where(~held), most_contexts=300_000)
    assert 100_000 < len(whole.log10) < 300_000
    import pyarrow as pa

    want = whole.score(*text_buffer(pa.array([t or "" for t in texts])))
    got = {r.doc_id: r.score for r in ppm.score(rows, held, chunk_bytes=200_000).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-4)


def test_media_round_trip_and_sequences(spark):
    assert media.decode(media.encode(bytes(range(64)))) == bytes(range(64))
    items = media.parse('<p>One<figure><img src="media:ab" alt="x"><figcaption>A <b>cap</b></figcaption></figure><p>Two<script>no</script><img src="u.png" alt="alt">')
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in items] == [(0, "text", "One", None, None), (1, "media", None, "ab", "A cap"), (2, "text", "Two", None, None), (3, "media", None, None, "alt")]
    assert media.parse(None) == []


def test_long_addresses_and_inline_payloads(spark, tmp_path):
    import base64

    payload, url = bytes(range(256)) * 9 + b"end", "https://example.com/" + "a" * 5000
    html = f'<p>x<img src="{url}"><img src="data:image/png;base64,{base64.b64encode(payload).decode()}">'
    assert [x["source"] for x in media.parse(html) if x["kind"] == "media"][0] == url
    items = media.sequences(spark.createDataFrame([(1, html)], "page_id long, html string"))
    media.store(spark.createDataFrame([("t",)], "text string"), f"{tmp_path}/media")
    media.store_inline(items, f"{tmp_path}/media")
    got = {r.position: r for r in media.resolve(items, media.describe(spark, f"{tmp_path}/media"), "page_id").collect()}
    assert (got[1].payload_bytes, got[2].payload_bytes, got[2].payload_sha256) == (None, len(payload), hashlib.sha256(payload).hexdigest())


def test_learned_operators_hold_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in quality.query(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in got) >= 0.95 * len(got)
    rows = [r for r in toxicity.query(spark, d).collect() if r.doc_id in labels]
    assert sum(r.rejected for r in rows if not labels[r.doc_id].toxic) == 0
    assert sum(r.rejected for r in rows if labels[r.doc_id].toxic) >= 30


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    import public_tokenizers
    from pyspark.sql import functions as F

    for df in (substrings.remove_repeats(none), neardup.near_duplicates(none), packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")), mixing.curriculum(none), pii.all_spans(none), ppm.score(none, F.lit(False)), fingerprints.with_next(none.select("doc_id", "text"))):
        assert df.count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and set(r.doc_id for r in out.select("doc_id").distinct().collect()) <= set(r.doc_id for r in docs.select("doc_id").collect())


CLASHES = ["toxic", "toxic_poor", "spans", "size", "taken", "same", "position", "k", "cut", "whole", "part", "mine", "h", "_id", "_h", "_text", "component_id", "kept", "node", "value", "start", "order", "a.b"]


@pytest.mark.parametrize("stage", ["keep_clean", "one_of_each", "redact", "take"])
def test_stages_keep_clashing_columns(spark, docs, stage):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    run = {"keep_clean": lambda d: toxicity.keep_clean(d, labels), "one_of_each": neardup.one_of_each, "redact": pii.redact, "take": mixing.take}[stage]
    extra = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])
    plain, found = run(docs), run(extra)
    assert found.columns == extra.columns
    rows = found.collect()
    assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHES)
    key = lambda r: tuple(str(r[c]) for c in docs.columns)
    assert rows and sorted(map(key, rows)) == sorted(map(key, plain.collect()))
