"""Edge cases and brute-force checks of the training-data operators."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from spanlight.llm import ann, components, jaccard, langid, media, mixing, packing, pii, simhash, substring, tokenfile, tokens, toxicity
from spanlight.llm.common import shared_dir, vocabulary_path
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fingerprint string, block int, pivot int, topic string, spans string, held_out string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 12, n), rng.integers(0, 50, n)))


@pytest.fixture(scope="module")
def texts():
    shared = prose(60, 99)
    rows = [prose(80, i) for i in range(12)]
    rows += [rows[0], rows[0], rows[1] + " x", "", None, " \n\t ", "one", "one two", "12345 678", "é ñ ü ß 日本"]
    rows += [prose(30, 50) + " " + shared + " " + prose(30, 51), shared + " tail", " ".join(["again"] * 90), prose(20_000, 7)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with extra columns whose names clash with those of results; nulls in all of them."""
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "de", None if i % 7 == 0 else f"s{i % 3}", None, *[None] * 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# SimHash


def slow_fingerprint(text, n=3):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    parent = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {p: find(parent, p) for p in prints}


def test_fingerprints(texts):
    for t in texts[:20]:
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t)


def test_near_duplicates(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in enumerate(texts)}
    roots = slow_components(set(prints.values()))
    first = {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    assert {i: r.component_id for i, r in got.items()} == {i: first[roots[p]] for i, p in prints.items()}
    assert all(int(got[i].fingerprint, 16) == p for i, p in prints.items())


def test_ball_links_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    prints = set(base)
    for b in base:
        for bits in ((0,), (63,), (0, 63), (1, 2, 3), (31, 32, 63), (5, 6, 7, 8), (0, 40, 41)):
            prints.add(b ^ sum(1 << i for i in bits))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    chosen = {r.fp for r in simhash.candidates(df).collect()}
    partnered = {a for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= 3}
    assert partnered <= chosen
    edges = [(r.a, r.b) for r in simhash.links(df).collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in edges)
    parent = {p: p for p in signed}
    for a, b in edges:
        parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    slow = slow_components({p % 2**64 for p in signed})
    groups = lambda root: sorted(sorted(p % 2**64 for p in signed if root(p) == r) for r in {root(p) for p in signed})
    assert groups(lambda p: find(parent, p)) == groups(lambda p: slow[p % 2**64])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (700, 701)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {700: 700, 701: 700}


def test_deduplicate_keeps_columns(docs):
    out = jaccard.deduplicate(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert 0 in kept and 12 not in kept and 13 not in kept


# Substrings


def slow_removal(texts, window):
    words = {i: (t or "").encode().split() for i, t in enumerate(texts)}
    seen = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("block", [1 << 17, 64])
def test_repeated_spans(docs, texts, block, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", block)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.drop_repeats(docs).collect()}
    assert got == slow_removal(texts, 35)
    assert got[24][1] == 90 and got[0][1] == 80


def test_rolled_hashes_tell_words():
    h = substring.word_hashes([b"a", b"b", b"a", b"b", b"a", b"b", b"c"])
    r = substring.rolled(h, 3)
    assert r[0] == r[2] and len(set(r.tolist())) == 3
    assert len(substring.rolled(h, 8)) == 0


# Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


ODD = [
    "a@b.co@c.de", "a@b.com_x@y.zz z@q.w.", "1.2.3.4.5.6.7.8", "0255.1.1.1 256.1.1.1", "4111 1111-1111 1111", "4111  1111 1111 1111", "é😀 a@b.co 😀 +123456789", "@@a@@b.co",
    "a@b..c", "00000000000000000000 0000 0000 0000", None, "", "+1+1 234 567 890 12", "..1.1.1.1..", "9" * 4000, "1." * 4000, "a." * 6000 + "@b.c", "+1" + " " * 3000,
]


def test_pattern_spans(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    for r in pii.report(df).collect():
        want = slow_spans(ODD[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), ODD[r.doc_id]
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(want)
        assert r.spans == ",".join(want)


def test_disclosive_words(spark):
    rows = [(i, f"{prose(30, i)} operator zorbax calls a{i}@mail.org today {prose(30, 100 + i)}") for i in range(6)]
    rows += [(50 + i, prose(60, 200 + i) + " today operator calls") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    for i, text in rows[:6]:
        at = text.index("zorbax")
        assert f"term:{at}:{at + 6}" in got[i].split(",") and "email" in got[i]
    assert all(got[50 + i] == "" for i in range(40))
    clean = {r.doc_id: r.text for r in pii.sanitize(df, length=None).collect()}
    assert all("[EMAIL]" in clean[i] and "[TERM]" in clean[i] and "@" not in clean[i] and "zorbax" not in clean[i] for i in range(6))
    assert all(clean[i] == t for i, t in rows[6:])


# Languages


def test_recurrent_network_gradients():
    rng = np.random.default_rng(0)
    gru = langid.Gru(rng.standard_normal((257, 9)).astype(np.float32) * 0.3, rng.standard_normal((3, 9)).astype(np.float32) * 0.3)
    ids, weights = rng.integers(0, 256, (5, 4)), rng.standard_normal((5, 4, 3)).astype(np.float32)
    keep = []
    gru.run(ids, keep)
    d_inputs, d_state = gru.back(ids, keep, weights)
    for array, grad in ((gru.state, d_state), (gru.inputs, d_inputs)):
        for at in [(0, 0), (1, 4), (2, 8)] if array is gru.state else [(int(ids[0, 0]), 2), (int(ids[3, 1]), 7)]:
            old = array[at]
            ends = []
            for step in (0.01, -0.01):
                array[at] = old + np.float32(step)
                ends.append(float((gru.run(ids) * weights).sum(dtype=np.float64)))
            array[at] = old
            assert grad[at] == pytest.approx((ends[0] - ends[1]) / 0.02, rel=0.02, abs=2e-3)


def test_language_accuracy_and_edges(spark):
    english = "the quick brown fox and the lazy dog with that this which there".split()
    german = "der schnelle braune fuchs und die faule hund mit dass nicht über".split()
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(english if i % 2 else german, 40)), "en" if i % 2 else "de") for i in range(240)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !? 45", "de"), (903, rows[0][1] * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "de"
    held = [i for i, _, _ in rows[:240] if got[i].held_out]
    assert held and np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got} == {i: r.held_out for i, r in got.items()}
    kept = langid.keep_identified(df.withColumn("lang_pred", F.lit(None).cast("string")).withColumn("score", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {r.doc_id for r in kept.collect()} == set(got) - {900, 901, 902}


def test_no_language_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}


# Toxicity


def test_nonnegative_risk(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, prose(40, i) + (" " + " ".join(rng.choice(["vile", "rotten", "nasty"], 2)) if bad else "")))
        if i % 2 == 0:
            labels.append((i, int(bad), 1))
    rows += [(900, None), (901, ""), (902, prose(20_000, 3))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = spark.createDataFrame(labels + [(None, 1, 1), (0, 1, 1)], "doc_id bigint, toxic int, quality int")
    scorer = toxicity.fit(docs, truth)
    assert all(r >= 0 for r in scorer.risks) and scorer.risks[-1] < scorer.risks[0]
    got = {r.doc_id: r.score for r in toxicity.score(docs, scorer).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] < 0.5 and got[902] < 0.5
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, none) is None
    assert {r.score for r in toxicity.score(docs.select("doc_id", "text"), None).collect()} == {0.0}


# Media


def jpeg(width, height, parts):
    """A small progressive file, written bit by bit with general tables, restart intervals and 4:2:0 chroma."""
    out = [b"\xff\xd8", media._segment(0xDB, b"\0" + bytes([3] * 64)), media._segment(0xC2, b"\x08" + struct.pack(">HH", height, width) + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0")]
    symbols = [0, 1, 2, 3, 4, 5, 6, 0x11, 0x12, 0x21, 0xF0, 0x01 << 4 | 0x0, 0x20, 0x51]
    for kind in (0, 1):
        out.append(media._segment(0xC4, bytes([kind << 4]) + bytes([0] * 4 + [len(symbols)] + [0] * 11) + bytes(symbols)))
    return out, {s: f"{k:05b}" for k, s in enumerate(symbols)}


def pack_bits(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def size_bits(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def test_general_progressive_scans():
    rng = np.random.default_rng(5)
    width, height = 40, 24
    out, code = jpeg(width, height, None)
    grids = {1: (4, 6), 2: (2, 3), 3: (2, 3)}  # blocks down and across, padded to whole MCUs
    cover = {1: (3, 5), 2: (2, 3), 3: (2, 3)}
    coefs = {c: np.zeros((*g, 64), int) for c, g in grids.items()}
    for c in coefs:
        coefs[c][:, :, 0] = rng.integers(-20, 20, grids[c])
        for _ in range(6):
            k = rng.integers(1, 64)
            coefs[c][:, :, k] = rng.integers(-3, 4, grids[c])
    # First DC scan with one bit left out, in restart intervals of two MCUs.
    mcus = [(r, q) for r in range(2) for q in range(3)]
    blocks = lambda r, q: [(1, 2 * r + i, 2 * q + j) for i in range(2) for j in range(2)] + [(2, r, q), (3, r, q)]
    data, refine = b"", ""
    for at in range(0, 6, 2):
        bits, last = "", {1: 0, 2: 0, 3: 0}
        for r, q in mcus[at : at + 2]:
            for c, y, x in blocks(r, q):
                v = int(coefs[c][y, x, 0]) >> 1
                n, extra = size_bits(v - last[c])
                bits, last[c] = bits + code[n] + extra, v
        data += (bytes([0xFF, 0xD0 + at // 2 - 1]) if at else b"") + pack_bits(bits).replace(b"\xff", b"\xff\0")
    out += [media._segment(0xDD, b"\0\2"), media._segment(0xDA, b"\x03\x01\0\x02\0\x03\0" + b"\0\0\x01") + data, media._segment(0xDD, b"\0\0")]
    for r, q in mcus:
        for c, y, x in blocks(r, q):
            refine += str(int(coefs[c][y, x, 0]) & 1)
    out.append(media._segment(0xDA, b"\x03\x01\0\x02\0\x03\0" + b"\0\0\x10") + pack_bits(refine).replace(b"\xff", b"\xff\0"))
    for c in coefs:
        down, across = cover[c]
        bits = ""
        for y in range(down):
            for x in range(across):
                k, run = 1, 0
                row = np.sign(coefs[c][y, x]) * (np.abs(coefs[c][y, x]) >> 1)
                while k < 64:
                    if not row[k:].any():
                        bits += code[0]
                        break
                    run = int(np.flatnonzero(row[k:])[0])
                    while run > 15:
                        bits, run, k = bits + code[0xF0], run - 16, k + 16
                    # Symbols with other runs are not in the table, so zeros are skipped through refinement below.
                    n, extra = size_bits(int(row[k + run]))
                    if (run << 4 | n) not in code:
                        coefs[c][y, x, k + run] = np.sign(coefs[c][y, x, k + run]) if abs(coefs[c][y, x, k + run]) > 1 else coefs[c][y, x, k + run]
                        row[k + run] = 0
                        continue
                    bits += code[run << 4 | n] + extra
                    k += run + 1
        out.append(media._segment(0xDA, bytes([1, c, 0]) + b"\x01\x3f\x01") + pack_bits(bits).replace(b"\xff", b"\xff\0"))
        bits = ""
        for y in range(down):
            for x in range(across):
                row, known = coefs[c][y, x], np.abs(coefs[c][y, x]) >> 1 > 0
                k = 1
                while k < 64:
                    new = [j for j in range(k, 64) if not known[j] and abs(row[j]) == 1]
                    zeros = [j for j in range(k, new[0] if new else 64) if not known[j]] if new else []
                    if not new or len(zeros) > 2 or (len(zeros) << 4 | 1) not in code:
                        for j in range(k, 64):
                            if not known[j] and abs(row[j]) == 1:
                                row[j] = 0
                        bits += code[0] + "".join(str(abs(int(row[j])) & 1) for j in range(k, 64) if known[j])
                        break
                    bits += code[len(zeros) << 4 | 1] + ("1" if row[new[0]] > 0 else "0")
                    bits += "".join(str(abs(int(row[j])) & 1) for j in range(k, new[0]) if known[j])
                    k = new[0] + 1
        out.append(media._segment(0xDA, bytes([1, c, 0]) + b"\x01\x3f\x10") + pack_bits(bits).replace(b"\xff", b"\xff\0"))
    image = media.read_coefficients(b"".join(out) + b"\xff\xd9")
    for c in coefs:
        down, across = cover[c]
        assert (image.components[c].coefs[:down, :across, 1:] == coefs[c][:down, :across, 1:]).all()
        assert (image.components[c].coefs[:, :, 0] == coefs[c][:, :, 0]).all()
    rgb = np.concatenate(list(media.rgb_strips(image, 1)))
    assert rgb.shape == (height, width, 3)
    assert (rgb == np.concatenate(list(media.rgb_strips(image, 99)))).all()


def test_inverse_transform_of_one_coefficient():
    block = np.zeros(64, np.float32)
    block[0] = 80
    assert np.allclose(block @ media.IDCT, 10, atol=1e-4)
    assert media.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(media.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 3, b"\xff" * 5000, b"\0" * 70_000])
def test_payload_round_trip(data):
    padded = data + b" " * (-len(data) % 192 if data else 192)
    image = media.read_coefficients(media.write_payload(padded, len(data)))
    assert media.read_payload(image) == (padded, len(data))


def test_media_columns(docs, texts, spark):
    files = media.encode_texts(docs)
    got = {r.doc_id: r for r in media.read_back(files).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert got[0].feature == got[12].feature and got[0].media_sha256 == got[12].media_sha256
    some = files.where("doc_id in (0, 19)").select("media", F.col("doc_id").alias("height")).union(spark.createDataFrame([(b"junk", 7), (None, 8)], "media binary, height bigint"))
    shapes = [(r.height, r.width, r.rgb and len(r.rgb)) for r in media.decode_images(some).collect()]
    assert sum(s == (None, None, None) for s in shapes) == 2 and all(n == h * w * 3 for h, w, n in shapes if h)


# Tokens


@pytest.mark.parametrize("make", [tokens.byte_encoder, tokens.word_encoder])
def test_pieces_give_the_ids_of_whole_texts(make, texts):
    encoder = make()
    odd = ["", " ", "a", " a", "a ", "a\n", "\na", "a\n b", "a \nb", "it's don't I'LL 'S", "a  b", "\x1cx y", "<|endoftext|> x", "a<|startoftext|>b <|endoftext|>", "日本語 テキスト", "ǆ ﬁ İ Σας", "123 45,6", "a\tb", "a\r\nb", "\x85 a\xa0b", "🙂 a🙂b", "é ́x", "x_y __z ²½ª"]
    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json" if make is tokens.byte_encoder else "word_bpe_49k.json"))
    for t in odd + [t or "" for t in texts]:
        assert encoder.encode(t) == b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids), t[:40]


def test_token_files(spark, docs, texts):
    folder = shared_dir(spark)
    shards = tokenfile.write(docs, folder)
    got = sorted(tokenfile.read(spark, folder, shards).collect())
    encoder, start = tokens.byte_encoder(), 0
    for i, t in enumerate(texts):
        ids = encoder.library(t or "") + struct.pack("<I", 2)
        assert tuple(got[i]) == (i, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    one = tokenfile.Shard(folder, shards[0]["shard"])
    key = int(one.index["id"][0])
    assert one.find(key).astype("<u4").tobytes() == encoder.library(texts[key] or "") + struct.pack("<I", 2)
    assert one.find(10**9) is None


# Packing


def slow_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(2))
def test_sweeps_place_every_piece_once(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400).tolist() + [64] * 3 + [1] * 40
    counts = Counter(lengths)
    used, placed = Counter(), Counter()
    flows = packing.sweeps(spark.createDataFrame(list(counts.items()), "length bigint, n bigint"), 64).collect()
    for length, first, n, per, sequence, at in flows:
        for r in range(n):
            s = sequence + r // per
            placed[length, first + r] += 1
            used[s] += length
            assert at + (r % per + 1) * length <= 64
    assert placed == {(x, r): 1 for x, n in counts.items() for r in range(n)} and max(used.values()) <= 64
    assert len(used) <= slow_best_fit(lengths, 64) * 1.02 + 1


def test_packed_documents(docs, texts):
    rows = packing.pack(docs, capacity=256).collect()
    encoder = tokens.word_encoder()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = encoder.library(t or "") + b"\0\0\0\0"
        for p in range(-(-len(ids) // 1024)):
            part = ids[p * 1024 : (p + 1) * 1024]
            r = by_doc[i].pop(p)
            assert (r.start, r.length, r.ids_crc32) == (p * 256, len(part) // 4, zlib.crc32(part))
        assert not by_doc[i]
    for places in by_sequence.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 256
    assert len(by_sequence) <= slow_best_fit([r.length for r in rows], 256) * 1.02 + 1


# Mixing


def test_raked_marginals(spark):
    rows = [(f"s{i % 4}", f"l{i // 4 % 3}", f"t{i // 12 % 2}", 10 + (i * 37) % 90) for i in range(72)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    out = mixing.rake(cells).toPandas()
    for d, columns in mixing.DIMS.items():
        share = out.groupby(columns).raked.sum()
        target = out.groupby(columns)[f"target_{d}"].first()
        assert np.allclose(share, target, atol=1e-6) and math.isclose(share.sum(), 1, abs_tol=1e-9)


def test_sampling_is_calibrated(spark, docs, texts):
    keyed, names = mixing.describe(docs)
    out = mixing.calibrate(keyed, names)
    assert names["topic"] == "_topic" and out.count() == len(texts)
    rows = out.select("doc_id", names["weight"], names["copies"]).collect()
    assert all(abs(r[2] - r[1] * 0.6) <= 1 for r in rows)
    once, twice = (sorted(r.doc_id for r in mixing.sample_mixture(docs).collect()) for _ in range(2))
    assert once == twice == sorted(r[0] for r in rows for _ in range(r[2]))
    assert mixing.sample_mixture(docs).columns == docs.columns


# Neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((10, 16))
    x = (centres[rng.integers(0, 10, 1500)] + 0.7 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8), (5004, [float("inf")] + [0.0] * 15), (5005, [1.0, 2.0]), (5006, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = 0
    for i in range(0, 1500, 20):
        s = x.astype(float) @ x[i].astype(float)
        s[i] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:10]
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(v != i and math.isclose(q, s[v], rel_tol=1e-9) for _, v, q in mine)
        found += len(set(best.tolist()) & {v for _, v, _ in mine})
    assert found / (75 * 10) >= 0.9 and set(got) == set(range(0, 1500, 20))


def test_few_vectors_find_all(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in ann.neighbours(df, df.where("vec_id = 0")).collect()]
    assert sorted(got) == [(0, 1, 4, 6.0), (0, 2, 3, 5.0), (0, 3, 2, 4.0), (0, 4, 1, 3.0)]


# Empty tables


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert substring.drop_repeats(empty).count() == 0
    assert pii.report(empty).count() == 0 and pii.sanitize(empty).count() == 0
    assert langid.identify(empty).count() == 0
    assert media.read_back(media.encode_texts(empty)).count() == 0
    assert packing.pack(empty).count() == 0
    assert mixing.sample_mixture(empty).count() == 0
    folder = shared_dir(spark)
    assert tokenfile.read(spark, folder, tokenfile.write(empty, folder)).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert ann.neighbours(vectors, vectors).count() == 0
    assert toxicity.fit(empty, spark.createDataFrame([], "doc_id bigint, toxic int")) is None


def test_clashing_columns_survive(docs):
    for out in (jaccard.deduplicate(docs), langid.keep_identified(docs), pii.sanitize(docs), mixing.sample_mixture(docs)):
        assert out.columns == docs.columns
        out.collect()


def test_plain_new_words_need_no_pattern(monkeypatch):
    encoder = tokens.BytePieces(vocabulary_path("byte_bpe_50k.json"), 4)
    asked, pattern = [], encoder.parts

    class Counted:
        def findall(self, word):
            asked.append(word)
            return pattern.findall(word)

    monkeypatch.setattr(encoder, "parts", Counted(), raising=False)
    text = "x " + " ".join(f"{a}thn{b}on{mark}" for a in "abcd" for b in "efgh" for mark in ("", ".", ",", "?!", "...")) + " it's 12. é. !? a-b"
    for kept in (450_000, 3):
        monkeypatch.setattr(encoder, "kept_parts", kept, raising=False)
        encoder.spaced.clear()
        encoder.known_parts.clear()
        assert encoder.encode(text) == encoder.library(text)
    assert set(asked) <= {"x", " it's", " 12.", " é.", " !?", " a-b"}


def test_new_words_reach_the_merges_together(monkeypatch):
    encoder = tokens.BytePieces(vocabulary_path("byte_bpe_50k.json"), 4)
    asked, part = [], encoder.part
    monkeypatch.setattr(encoder, "part", lambda p: asked.append(p) or part(p))
    text = "Start " + " ".join(f"{a}thn{b}on{mark}" for a in "abcdé" for b in "efghü" for mark in ("", ".", ",", "?!", "...")) + " 12. 345\nNext line,\n67; end's"
    assert encoder.encode(text) == encoder.library(text)
    assert set(asked) <= {"Start", " end", "'s"}


@pytest.mark.parametrize("kept, together, pieces", [(500_000, 1 << 22, 10_000), (5, 40, 3), (1, 1, 1)])
def test_many_texts_are_cut_together(texts, monkeypatch, kept, together, pieces):
    monkeypatch.setattr(tokens, "KEPT_SPACED", kept)
    monkeypatch.setattr(tokens, "TOGETHER", together)
    monkeypatch.setattr(tokens, "TOGETHER_PIECES", pieces)
    encoder = tokens.BytePieces(vocabulary_path("byte_bpe_50k.json"), 4)
    odd = ["", " a b", "\na\nb\n", "\n", " ", "a  b", "a\n\nb", "a \nb", "\n b", "tab\tx", "it's we'll 'tis ''", "a<|endoftext|>b", "\u0120a \u010ab", "x\u00a0y", "\u00aa\u00b5 \u00d7\u00f7", "12ab 3.4, 5!6", " \u00e9l\u00e8ve, \u00c7a! na\u00efve...", "a.b ,c !!", " (a_b) [c]\n{d}~\n^e` 1-2/3 <|end|> <f@g.hi>=#%$&+\\j;:?", "?! a1b2 3.c", "\ud55c\uad6d \u0627\u0644 \U0001f600. x\u0301y", "\u00c3\u00a9 \u00c3."]
    many = odd + [t or "" for t in texts if len(t or "") < 2_000] + odd[::-1]
    assert list(encoder.encode_all(many)) == [encoder.library(t) for t in many]
    assert list(encoder.encode_all([])) == [] and list(encoder.encode_all(["", ""])) == [b"", b""]
