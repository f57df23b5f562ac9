"""PII, SimHash, language ID, quality rules, passage classifier and packing
against brute-force versions, and the odd rows each must stand."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vulnxml.llm import lang_id, packing, pii, quality_mil, quality_rules, simhash
from vulnxml.llm.common import held_out

ODD = [None, "", " \n\t", "a", "ab cd", "x" * 100_000, "word " * 30_000, "çéñ ß 日本 \U0001f600", "same text here", "same text here"]


# ---------------------------------------------------------------- PII

def brute_base(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_pii_equals_patterns_on_random_text():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("aZ09@..--+ () _%\n12255") for _ in range(r.randint(0, 60)))
        got = [x[:3] for x in pii.find_spans(t) if x[0] in pii.BASE_KINDS]
        assert got == sorted(brute_base(t), key=lambda x: (pii.BASE_KINDS.index(x[0]), x[1])), t


def test_pii_cards_and_chains():
    assert [x[:3] for x in pii.find_spans("4111 1111-1111 1111.")] == [("card", 0, 19)]
    assert [x[:3] for x in pii.find_spans("1.2.3.4.5.6.7.8.9 300.1.1.1")] == [("ip", 0, 7), ("ip", 8, 15)]
    assert pii.find_spans("+1 " + "9" * 200_000) == []
    assert pii.find_spans("a" * 200_000 + "@" + "b" * 1000) == []


def test_pii_checksums_and_context():
    kinds = lambda t: [x[0] for x in pii.find_spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 thanks") == ["iban"]
    assert kinds("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert kinds("call 555-123-4567 now") == ["local_phone"] and kinds("part 555-123-4567 now") == []
    assert kinds("amex card 378282246310005") == ["short_card"] and kinds("378282246310005") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("123-45-6789") == []


def test_pii_redaction_leaves_clean_text():
    assert pii.redact_text("write a.b@c.de or +49 (30) 1234-5678!") == "write [EMAIL] or [PHONE]!"
    assert pii.redact_text("nothing here, 12 of 30.") == "nothing here, 12 of 30."


def test_pii_digest_odd_rows(make_docs):
    rows = pii.digest(make_docs(ODD + ["x@y.zz 1.2.3.4", (None, "q@r.st")], extra={"spans": 1, "id": "x"})).collect()
    assert len(rows) == len(ODD) + 2
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[0]["spans"] == ""
    assert (by[10]["n_email"], by[10]["n_ip"]) == (1, 1) and by[10]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert by[None]["n_email"] == 1
    assert pii.digest(make_docs([])).count() == 0


# ---------------------------------------------------------------- SimHash

def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints():
    for t in [*ODD, "A b C d E", "one\x0btwo\x0cthree four five\rsix", "É Ä b c d e"]:
        assert simhash.fingerprint_text(t) == brute_print(t), t


def near(rng, n=400):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            x = rng.choice(out)
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
        else:
            x = rng.getrandbits(64)
        out.append(x)
    return out


@pytest.mark.parametrize("wanted, most", [(64, 1000), (1, 1000), (64, 5)])
def test_links_give_all_components(spark, wanted, most):
    fps = sorted(set(near(random.Random(wanted + most))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    edges = simhash.links(df, 4, max_trie=most, wanted=wanted)
    root = {r["node"]: r["root"] for r in simhash.connected(edges).collect()}
    want = brute_components(fps)
    groups, got = defaultdict(set), defaultdict(set)
    for i, (s, w) in enumerate(zip(signed, want)):
        groups[w].add(s)
        got[root.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_trie_prunes_a_dense_cluster():
    """Thousands within a few bits of each other: one component, little work."""
    rng = np.random.default_rng(1)
    base = np.uint64(rng.integers(1 << 62))
    flips = np.array([sum(1 << int(b) for b in rng.choice(50, rng.integers(0, 4), replace=False)) for _ in range(20_000)], np.uint64)
    keys = np.unique(base ^ flips)
    assert len(np.unique(simhash.trie_components(keys, np.array([0]), np.array([len(keys)]), 0, 4))) == 1


def test_near_duplicates_odd_rows(make_docs):
    docs = make_docs(ODD + [(5, "dup id"), (None, "no id at all"), (None, "")], extra={"fp": "clash", "component_id": 0})
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [brute_print(t) for _, t in texts]
    comp = brute_components(prints)
    low = {}
    for c, (i, _) in zip(comp, texts):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    want = Counter((i, f"{p:016x}", low[c]) for (i, _), p, c in zip(texts, prints, comp))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_keep_one(make_docs):
    docs = make_docs([*ODD, (8, "same text here"), (None, "same text here"), (None, "alone without id here")], extra={"keep_id": "clash"})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    comps = brute_components([brute_print(r["text"]) for r in docs.collect()])
    assert kept.count() == len(set(comps))
    assert [r["doc_id"] for r in kept.where("text = 'same text here'").collect()] == [8]


# ---------------------------------------------------------------- language ID

def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lang_id.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    assert got.where("rejected").count() == 0
    kept = lang_id.drop_rejected(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_language_equals_plain_cosines(spark, sf):
    """IDF counted and cosines summed bucket by bucket, for every row of the table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    train = [r["text"] for r in rows if r["text"] is not None and r["lang"] is not None and not held[r["doc_id"]]]
    df = Counter(int(b) for t in train for b in np.flatnonzero(lang_id.counts(t)))
    idf = [math.log((1 + len(train)) / (1 + df[b])) + 1 for b in range(1 << lang_id.BITS)]
    model = lang_id.fit(docs)
    assert np.allclose(model.idf, idf, rtol=1e-5) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-3)
    got = {r["doc_id"]: r for r in lang_id.language(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        found = got[r["doc_id"]]
        assert found["held_out"] == held[r["doc_id"]]
        if not lang_id.has_letter(r["text"]):
            assert (found["lang_pred"], found["score"], found["rejected"]) == ("und", 0.0, True)
            continue
        seen = lang_id.counts(r["text"])
        v = {int(b): math.log1p(float(seen[b])) * idf[b] for b in np.flatnonzero(seen)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[b]) for b, x in v.items()) / norm for c in model.centroids]
        assert abs(found["score"] - max(cos)) < 1e-4
        near = {model.langs[model.owner[i]] for i, c in enumerate(cos) if c > max(cos) - 1e-4}
        floor = float(model.floor[min(len(r["text"]).bit_length(), len(model.floor) - 1)])
        assert found["lang_pred"] in near
        assert found["rejected"] == (max(cos) < floor) or abs(max(cos) - floor) < 1e-4


def test_language_odd_rows(make_docs):
    docs = make_docs([*ODD, "12 34 !!", *["the cat and the dog of the house " * 5 + str(i) for i in range(30)]], extra={"score": 1, "language": "x"})
    rows = {r["doc_id"]: r for r in lang_id.language(docs).collect()}
    for i in (0, 1, 2, 10):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0
    assert rows[20]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in rows.values())
    assert lang_id.language(make_docs([])).count() == 0
    assert {r["lang_pred"] for r in lang_id.language(make_docs(["some text"], lang=None)).collect()} == {"und"}
    assert "language" in lang_id.drop_rejected(docs).columns


def test_other_languages_are_rejected(spark, make_docs):
    """Short and long, while short texts of the sampled languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs)
    strange = ["Это короткий русский текст", "Привет, как дела сегодня", "今天天气很好我们去公园散步然后回家吃饭", "สวัสดีชาวโลก ยินดี", "zzxq kvvj qqpw xjkz", "Szczęście wszystkich"]
    assert all(model.predict(t)[2] for t in strange)
    assert all(model.predict((t + ". ") * 30)[2] for t in strange)
    short = [r["text"] for r in docs.where("length(text) < 64 and length(text) > 3").collect() if lang_id.has_letter(r["text"])]
    assert len(short) > 10 and sum(model.predict(t)[2] for t in short) <= 0.02 * len(short)
    kept = lang_id.drop_rejected(docs.unionByName(make_docs([(10 ** 9 + i, t) for i, t in enumerate(strange)], lang=None))).where("doc_id >= 1000000000")
    assert kept.count() == 0


def test_language_learns_from_unheld_rows_alone(make_docs, spark):
    docs = make_docs(["text number %d of the lot" % i for i in range(60)])
    wrong = docs.withColumn("lang", F.when(held_out("doc_id"), "xx").otherwise("en"))
    assert {r["lang_pred"] for r in lang_id.language(wrong).collect()} == {"en"}


# ---------------------------------------------------------------- quality

def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    cover = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def test_rules_equal_brute_force():
    r, read = random.Random(2), quality_rules.Reader()
    for n in range(400):
        t = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "#", "\t", "ab ", "x\n", "日", "\x85", "\xa0"]) for _ in range(r.randint(0, 200)))
        assert read(t)[0] == brute_rules(t), t
    for t in ODD:
        assert read(t)[0] == brute_rules(t)


def test_verdicts(spark, sf, make_docs, make_labels):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.verdicts(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == labels.count()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows if not r["base_failed"]]) >= 0.9
    odd = make_docs(ODD, extra={"kept": 1})
    got = quality_rules.verdicts(odd, make_labels([])).collect()
    assert [[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] for r in sorted(got, key=lambda r: r["doc_id"])] == list(map(brute_rules, ODD))
    assert quality_rules.verdicts(make_docs([]), labels).count() == 0


def test_passage_classifier(spark, sf, make_docs, make_labels):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_mil.scores(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.85
    got = quality_mil.scores(make_docs(ODD, extra={"score": 2}), make_labels([(1, None, None)])).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.5}
    assert quality_mil.scores(make_docs([]), labels).count() == 0


def plain_passages(text):
    """Feature rows of a text, passage by passage and word by word (one block at most)."""
    q, b = quality_mil, (text or "").encode()
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", b))
    if not found:
        return [[0.0] * q.WIDTH]
    hasher, size, out = q.WordHasher(), 1 << q.BITS, []
    grams = q.trigram_buckets(q.utf8(text), q.BITS)
    groups = [found[i:i + q.PASSAGE] for i in range(0, len(found), q.PASSAGE)]
    cuts = [0, *(g[0].start() for g in groups[1:]), len(b)]
    for g, lo, hi in zip(groups, cuts, cuts[1:]):
        words = [m.group() for m in g]
        hashes = [hasher(np.frombuffer(w, np.uint8))[0] for w in words]
        counted = [Counter(int(q.word_buckets(h, q.BITS)[0]) for h in hashes), Counter(map(int, grams[lo:hi])), Counter(int(q._CLASS[c]) for c in b[lo:hi])]
        row = []
        for part, width in zip(counted, (size, size, 16)):
            logs = [math.log1p(part[i]) for i in range(width)]
            norm = max(math.sqrt(sum(v * v for v in logs)), 1e-6)
            row += [v / norm for v in logs]
        row += [len(set(words)) / len(words), sum(x == y for x, y in zip(words, words[1:])) / len(words),
                len(found) / (len(groups) * q.PASSAGE)]  # of the block, not of the passage
        out.append(row)
    return out


def test_passage_scores_equal_plain_attention(spark, sf):
    """Every text's features and attention worked out plainly, with the fitted weights."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_mil.fit(docs, labels)
    p = {n: v.astype(np.float64) for n, v in model.p.items()}
    got = {r["doc_id"]: r for r in quality_mil.scores(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        h = [np.tanh(np.array(x) @ p["E"] + p["e"]) for x in plain_passages(r["text"])]
        a = [float((np.tanh(x @ p["V"]) / (1 + np.exp(-(x @ p["U"])))) @ p["w"]) for x in h]
        share = [math.exp(x) / sum(map(math.exp, a)) for x in a]
        z = sum(s * x for s, x in zip(share, h))
        want = 1 / (1 + math.exp(-(model.slope * float(z @ p["c"] + p["b"]) + model.shift)))
        found = got[r["doc_id"]]
        assert abs(found["score"] - want) < 1e-3
        assert found["predicted"] == int(found["score"] >= 0.3) and found["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_passage_gradients():
    rng = np.random.default_rng(0)
    p = {n: v.astype(np.float64) for n, v in quality_mil.start().items()}
    bags = [rng.random((n, quality_mil.WIDTH)) for n in (1, 3, 2)]
    y, w = np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        m = quality_mil.Model(p)
        return sum(np.log1p(np.exp(-(2 * t - 1) * m.logit(iter([b])))) for b, t in zip(bags, y))

    g = quality_mil.gradients(p, bags, y, w)
    for name in ("E", "V", "U", "w", "c", "e"):
        at = tuple(0 for _ in p[name].shape)
        old, eps = p[name][at], 1e-5
        p[name][at] = old + eps
        up = loss()
        p[name][at] = old - eps
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-4, name


def test_bag_in_blocks_scores_the_same():
    rng = np.random.default_rng(0)
    m = quality_mil.Model(quality_mil.start())
    x = rng.random((50, quality_mil.WIDTH)).astype(np.float32)
    assert abs(m.logit(iter([x])) - m.logit(iter([x[:7], x[7:30], x[30:]]))) < 1e-4


# ---------------------------------------------------------------- packing

def brute_windows(ends, penalty, size):
    pos, pen = [0, *ends], [0, *penalty]
    cost, back = [0] + [float("inf")] * len(ends), [0] * len(pos)
    for j in range(1, len(pos)):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= size:
                power = n & (n - 1) == 0 and n >= min(packing.LEAST_POWER, size)
                c = cost[i] + (0 if power else size - n) + pen[j] + packing.WINDOW_COST
                if c < cost[j]:
                    cost[j], back[j] = c, i
    return cost[-1]


def test_windows_have_least_cost():
    r = random.Random(4)
    for size in (16, 64, 2048):
        for _ in range(60):
            ends, at = [], 0
            while len(ends) < 60:
                at += r.randint(1, size // r.choice([1, 2, 8]))
                ends.append(at)
            pen = [r.choice([0, 2, 24]) for _ in ends]
            cuts = packing.cut_windows(np.array(ends), np.array(pen), size)
            by = dict(zip(ends, pen))
            total, last = 0, 0
            for c in cuts:
                n = c - last
                assert 0 < n <= size
                power = n & (n - 1) == 0 and n >= min(packing.LEAST_POWER, size)
                total, last = total + (0 if power else size - n) + by[c] + packing.WINDOW_COST, c
            assert last == ends[-1] and total == brute_windows(ends, pen, size)


def check_pieces(rows, texts, size):
    enc = packing.Encoder()
    want = defaultdict(list)
    for i, t in texts:
        want[i].append([*enc.full.encode(t or "", add_special_tokens=False).ids, 1])
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] > 0
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= size
    for i, lists in want.items():
        own = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == i)
        if len(lists) == 1:
            at = 0
            for s, n, crc, total in own:
                assert s == at and total == len(lists[0]) and crc == zlib.crc32(np.array(lists[0][s:s + n], "<u4").tobytes())
                at += n
            assert at == len(lists[0])
        else:
            assert sum(n for _, n, _, _ in own) == sum(map(len, lists))


@pytest.mark.parametrize("size", [16, 2048])
def test_packing_holds_every_id_once(spark, make_docs, sf, size):
    texts = [(i, t) for i, t in enumerate([*ODD, "end <|endoftext|> token", "a. b! c?\n d", " lead", "two  spaces", "日本語。" * 3000])]
    texts += [(100 + i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect())] + [(101, "again"), (None, "no id")]
    docs = make_docs(texts, extra={"start": 3, "id": "clash"}).repartition(3)
    check_pieces(packing.pack(docs, size=size).collect(), texts, size)
    assert packing.pack(make_docs([])).count() == 0


def test_packing_pads_little(spark, sf):
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)).collect()
    length = Counter()
    for r in rows:
        length[r["sequence_id"]] += r["length"]
    full = sorted(length)[:-1]
    waste = sum(2048 - n for s, n in length.items() if s in full and n & (n - 1))
    assert waste <= 0.015 * sum(length.values())


def test_packing_ids_of_long_runs():
    """Runs of white space that end the rank merger's pattern, and any others."""
    import public_tokenizers
    from tokenizers import Tokenizer

    full, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder()
    for text in [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" * 1_000_000, "x" + "\t" * 60_000 + " y<|endoftext|>z"]:
        assert np.frombuffer(enc(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids
    for text in (" " * 5_000_000, "\n" * 5_000_000):
        assert len(enc(text)) >= 4


def test_queries_run_without_the_package_on_the_workers(tmp_path):
    """Every query from an empty folder, with workers that can't import the package."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as E
from vulnxml.session import get_spark
from vulnxml.llm.queries import QUERIES
spark = get_spark(app="apart", cpus=4, shuffle_partitions=4)
everything = E.queries()
for name in QUERIES:
    everything[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("ran ") >= 14
