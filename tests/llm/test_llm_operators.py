"""Each operator against a brute-force version, and its defined cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from halyard.llm import bpe, common, jaccard, language, neighbours, packing, pii, quotes, telephony, urls, warc
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD = [None, "", " ", "a", "\x1c\x1d x\u3000y", "<|endoftext|> no", "日本語 текст", "x" * 5000, "don't  stop\n\n now ", "😀 ok 123 ½"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def documents(spark, texts, **more):
    rows = [(k if k != 3 else None, t, *(v[k % len(v)] for v in more.values())) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {n} string" for n in more))


# --- byte-level BPE


@pytest.fixture(scope="module")
def plain_encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(spark, plain_encoding):
    rng = random.Random(1)
    texts = ODD + [prose(rng, rng.randint(1, 80)) for _ in range(40)] + ["same text"] * 20
    texts += ["".join(rng.choice(" \n\t'sabcÀéß1½\x1c\u2003!?") for _ in range(60)) for _ in range(30)]
    got = bpe.encode(documents(spark, texts, n_tokens=["clash"]).repartition(3)).collect()
    assert len(got) == len(texts)
    want = defaultdict(int)
    for k, t in enumerate(texts):
        ids = plain_encoding.encode_ordinary(t or "")
        want[(k if k != 3 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids))] += 1
    for r in got:
        want[(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids))] -= 1
    assert not any(want.values())


def test_bpe_of_nothing(spark):
    assert bpe.encode(documents(spark, [])).count() == 0


def test_numbers_and_words_pack():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert (bpe.unpack_numbers(bpe.pack_numbers(x)) == x).all()
    assert not len(bpe.unpack_numbers(bpe.pack_numbers(x[:0])))
    assert bpe.unpack_words(bpe.pack_words(["a", "", "é\0"])) == [b"a", b"", "é\0".encode()]


# --- packing


def check_packing(rows, texts, limits):
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), None)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, t in enumerate(texts):
        k = k if k != 3 else None
        ids = [*enc.slow.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        runs = sorted(by_doc[k], key=lambda r: r.start)
        assert [i for r in runs for i in r.ids] == ids
        assert [r.start for r in runs] == list(np.cumsum([0] + [r.length for r in runs])[:-1])
        for r in runs:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for runs in by_sequence.values():
        runs.sort(key=lambda r: r.offset)
        assert [r.offset for r in runs] == list(np.cumsum([0] + [r.length for r in runs])[:-1])
        assert sum(r.length for r in runs) <= limits.tokens and len(runs) <= limits.segments
        assert sum(r.length - 1 for r in runs) <= limits.loss_tokens
    return [sum(r.length for r in runs) for runs in by_sequence.values()]


def test_packing(spark):
    rng = random.Random(2)
    texts = ODD + [prose(rng, rng.choice([1, 3, 20, 100, 2000])) for _ in range(60)]
    df = documents(spark, texts, start=["clash"]).repartition(2)
    sizes = check_packing(packing.pack(df).collect(), texts, packing.Limits())
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    tight = packing.Limits(tokens=256, segments=3, loss_tokens=100, pool=8)
    check_packing(packing.pack(df, limits=tight).collect(), texts, tight)


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_many_one_token_documents(spark):
    texts = [""] * 3000
    rows = packing.pack(documents(spark, texts).coalesce(1)).collect()
    assert len(rows) == 3000 and max(r.offset for r in rows) == 511


# --- telephony


def slow_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = telephony.IMA_STEPS[index]
            diff = step >> 3
            diff += step * (n >> 2 & 1) + (step >> 1) * (n >> 1 & 1) + (step >> 2) * (n & 1)
            value = max(-32768, min(32767, value - diff if n & 8 else value + diff))
            index = max(0, min(88, index + telephony.IMA_MOVES[n & 7]))
            out.append(value)
    return out


def test_ima_blocks():
    rng = np.random.RandomState(3)
    data = rng.randint(0, 256, 288 * 3).astype(np.uint8)
    got = telephony.decode_ima(data)
    assert got.tolist() == [slow_ima(b.tobytes()) for b in data.reshape(3, -1)]


def test_expansion_tables():
    # fixed points of G.711
    assert telephony.mulaw_table()[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.alaw_table()[[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]


def test_resample():
    x = np.array([0, 10, -10], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 5, 10, 0, -10, -10]
    assert telephony.resample(x, 8000, 8000).tolist() == x.tolist()
    assert len(telephony.resample(np.zeros(80, np.int16), 8000, 11025)) == 110


def test_telephony_round_trip(spark):
    rng = random.Random(4)
    texts = ODD + [prose(rng, n) for n in (1, 80, 300, 90)] * 4
    got = telephony.telephony_columns(documents(spark, texts, codec=["clash"])).collect()
    assert len(got) == len(texts) and {r.codec for r in got} == set(telephony.CODECS)
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), [t for k, t in enumerate(texts) if k != 3] + [texts[3]], strict=True):
        raw = (t or "").encode()
        codec, rate, block, data = telephony.parse_wave(bytes(r.media))
        payload = bytes(data)
        assert payload.startswith(raw) and set(payload[len(raw) :]) <= {255} and len(payload) % 576 == 0 and 0 <= len(payload) - max(len(raw), 1) < 576
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        if codec == "ima_adpcm":
            pcm = np.array([v for k in range(0, len(payload), block) for v in slow_ima(payload[k : k + block])], np.int16)
        else:
            pcm = telephony.EXPAND[codec][np.frombuffer(payload, np.uint8)]
        assert telephony.resample(pcm, rate, 16000).tobytes() == bytes(r.pcm)


def test_telephony_reads_what_is_stored(spark, monkeypatch):
    """A change of the stored files shows in the result."""
    store = telephony.store_media
    swapped = lambda *a: store(*a).withColumn("media", F.expr("overlay(media placing X'00' from octet_length(media))"))
    df = documents(spark, ["some text", "x" * 600])
    plain = {r.doc_id: r for r in telephony.telephony_columns(df, keep_media=False).collect()}
    monkeypatch.setattr(telephony, "store_media", swapped)
    other = {r.doc_id: r for r in telephony.telephony_columns(df, keep_media=False).collect()}
    assert all(plain[k].payload_sha256 != other[k].payload_sha256 and plain[k].tail_crc32 != other[k].tail_crc32 for k in plain)
    assert telephony.telephony_columns(df.limit(0)).count() == 0


def test_packing_counts_loss_from_prompts(spark):
    run = lambda doc, n, prompt: packing.Run(doc, 0, n, np.zeros(n, np.uint32), prompt)
    packer = packing.Packer(packing.Limits(tokens=100, segments=9, loss_tokens=50))
    assert not [*packer.add(run("long", 60, 59)), *packer.add(run("lossy", 50, 10)), *packer.add(run("more", 45, 10))]
    first = next(packer.drain(0))
    assert [r.doc for r in first] == ["lossy", "long"]  # the longest run isn't the first choice; "more" fits by tokens but not by loss
    texts = [" ".join(WORDS[k % 9 :]) * 3 for k in range(40)]
    df = documents(spark, texts).withColumn("prompt", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 4 * 20)).coalesce(1)
    limits = packing.Limits(tokens=128, segments=4, loss_tokens=40, pool=8)
    rows = packing.pack(df, limits=limits, prompt_col="prompt").collect()
    loss, tokens, seen = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        prompt = (r.doc_id or 0) % 4 * 20
        loss[r.sequence_id] += sum(t >= prompt for t in range(r.start + 1, r.start + r.length))
        tokens[r.sequence_id] += r.length
        seen[r.doc_id] += r.length
    assert max(loss.values()) == 40 and max(tokens.values()) <= 128 and max(tokens.values()) > 44
    assert all(seen[r.doc_id] == r.doc_tokens for r in rows) and len(seen) == 40


def slow_packing(runs, limits):
    """Sequences of (doc, start, length) by the rule, one run at a time; what no rule fills in powers of two."""
    pool, out = [], []  # doc, start, length, prompt
    for doc, start, n, prompt in runs:  # a long one is cut where its prompt ends
        cut = [(0, prompt), (prompt, n - prompt)] if n > limits.tokens and 0 < prompt < n else [(0, n)]
        pool += [[doc, start + a, m, prompt] for a, m in cut]
    cost = lambda r, n: max(0, n - max(1, r[3] - r[1]))
    while pool:
        left, taken = [limits.tokens, limits.segments, limits.loss_tokens], []
        while pool and left[0] and left[1]:
            fits = [r for r in pool if r[2] <= left[0] and cost(r, r[2]) <= left[2]]
            room = lambda r: min(r[2], left[0], left[2] + max(1, r[3] - r[1]))  # noqa: E731, B023
            weigh = [a / b**2 for a, b in zip(left, (limits.tokens, limits.segments, limits.loss_tokens), strict=True)]
            value = lambda r: room(r) * weigh[0] + weigh[1] + cost(r, room(r)) * weigh[2]  # noqa: E731, B023
            if left[1] == 1:
                fits = [r for r in pool if room(r) == max(map(room, pool))]
            best = max(fits or pool, key=value)
            n = room(best)
            taken.append((best[0], best[1], n))
            left = [left[0] - n, left[1] - 1, left[2] - cost(best, n)]
            best[1], best[2] = best[1] + n, best[2] - n
            pool = [r for r in pool if r[2]]
        out.append(taken)
    return out


@pytest.mark.parametrize("limits", [packing.Limits(100, 9, 50), packing.Limits(64, 3, 64), packing.Limits(128, 5, 70), packing.Limits(100, 50, 20)])
def test_packing_is_the_rules(limits):
    """Against a slow packer; each of the limits binds, and the product chooses other runs than the longest."""
    rng = random.Random(limits.tokens + limits.segments)
    runs = [(k, 0, n, rng.randint(0, n)) for k in range(150) for n in [rng.choice([1, 2, 7, 30, 90])]]
    packer = packing.Packer(limits)
    for doc, start, n, prompt in runs:
        assert not list(packer.add(packing.Run(doc, start, n, np.zeros(n, np.uint32), prompt)))
    got = [[(r.doc, r.start, len(r.ids), r.loss()) for r in s] for s in packer.finish()]
    want = slow_packing(runs, limits)
    full = [s for s in want if sum(n for _, _, n in s) == limits.tokens]
    assert [[x[:3] for x in s] for s in got if sum(x[2] for x in s) == limits.tokens] == full
    sizes = [sum(x[2] for x in s) for s in got]
    assert all(n == limits.tokens or n & (n - 1) == 0 for n in sizes) and sum(sizes) == sum(r[2] for r in runs)
    assert max(len(s) for s in got) <= limits.segments and max(sum(x[3] for x in s) for s in got) <= limits.loss_tokens
    seen = defaultdict(list)
    for s in got:
        for doc, start, n, _ in s:
            seen[doc] += range(start, start + n)
    assert all(sorted(seen[k]) == list(range(n)) for k, _, n, _ in runs)


def test_query_limits_bind(spark, tmp_path):
    rng = random.Random(15)
    texts = [prose(rng, rng.choice([2, 8, 60, 400, 3000])) for _ in range(150)] + ["", None]
    documents(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op4_vector_packing(spark, str(tmp_path)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    loss = [sum(max(0, r.length - max(1, packing.drawn_prompt(r.doc_id, r.doc_tokens) - r.start)) for r in s) for s in by.values()]
    sizes = [sum(r.length for r in s) for s in by.values()]
    assert max(loss) == packing.QUERY_LIMITS.loss_tokens and max(map(len, by.values())) == packing.QUERY_LIMITS.segments
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes) and sum(n == 2048 for n in sizes) > 0.9 * sum(sizes) // 2048
    want = defaultdict(int)
    for r in rows:
        want[r.doc_id] += r.length
    assert all(want[r.doc_id] == r.doc_tokens for r in rows) and len(want) == len(texts)


# --- language ID

LANGS = {"one": "abcdefg", "two": "hijklmn", "three": "опрстуф"}


def labelled(spark, n=60):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        lang = list(LANGS)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark):
    df = labelled(spark)
    model = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[r.doc_id].lang_pred == r.lang and got[r.doc_id].score == 1 for r in df.collect())
    mixed = "abc defg abcd bcda gfe efg " * 4 + "hij klmn nmlk hijk lmn " * 3
    odd = documents(spark, [mixed, None, "12 !?", "", "абв", "漢字", "abc\n\nhij"], score=["clash"])
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, None)] == ["one", "und", "und", "und"]
    assert [s.lang for s in got[0].spans] == ["one", "two"] and mixed[got[0].spans[1].start :].startswith("hij")
    assert got[5].score == 0 and got[5].lang_pred in LANGS
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels(spark):
    df = documents(spark, ["abc", None])
    model = language.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(df, model).collect()} == {"und"}
    assert language.identify(documents(spark, []), model).count() == 0


def test_viterbi_is_exhaustive_search():
    import itertools

    rng = np.random.RandomState(6)
    scores, doc, prior = rng.normal(size=(12, 3)), np.repeat([0, 2, 3], [5, 6, 1]), np.log([0.5, 0.3, 0.2])
    got = language.viterbi(scores, doc, 4, prior, 0.7)
    for d in (0, 2, 3):
        own = scores[doc == d]
        value = lambda p: prior[p[0]] + sum(own[k, x] for k, x in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=len(own)), key=value)
        assert value(tuple(got[doc == d])) == pytest.approx(value(best))


# --- PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_match_plain_search():
    rng = random.Random(7)
    parts = ["a@b.c", "a@b", "@", ".", "x", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0001.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "_", " ", "-", "é", "9" * 30, "a.b@c-d.e_f@g.h"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert [x[:3] for x in pii.entities(text)] == brute_spans(text), text
    long = "a" * 200_000 + "1" * 200_000
    assert pii.entities(long + "@") == []


def test_disclosing_terms(spark):
    texts = [f"write to bob@x.org about zebrafish matters {k}" for k in range(6)] + [f"the weather about town is fine {k}" for k in range(40)] + [None, ""]
    df = documents(spark, texts, spans=["clash"])
    rule = pii.Disclosure(min_support=3, generalise=0.8, remove=0.95)
    got = {r.doc_id: r for r in pii.find_spans(df, rule=rule).collect()}
    # brute force over documents
    holds = [set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())) for t in texts]
    n, n_e = len(texts), 6
    for r in got.values():
        t = texts[3 if r.doc_id is None else r.doc_id] or ""
        want = brute_spans(t)
        for m in re.finditer(r"[^\W\d_]{3,}", t):
            if "bob" in t and m[0] in ("write", "about", "zebrafish", "matters"):
                share = np.log2(6 / sum(m[0] in h for h in holds) / (n_e / n)) / np.log2(n / n_e)
                if share >= 0.8:
                    want.append((m.start(), 5 if share >= 0.95 else 4, m.end()))
        assert sorted(map(tuple, r.spans)) == sorted(want)
    clean = {r.doc_id: r.text for r in pii.sanitise(df.drop("spans"), rule=rule).collect()}
    assert clean[0] == " to [EMAIL] about   0".replace("  0", "  0") and clean[10] == texts[10] and clean[46] is None and clean[47] == ""
    assert pii.find_spans(documents(spark, [])).count() == 0


def test_disclosing_terms_of_whole_documents(spark):
    far = " ".join(["the weather about town is fine today"] * 4)
    texts = [f"Zebrafish study: write to bob@x.org {k}" for k in range(5)] + [f"zebrafish study {far} write to bob@x.org {far} quagga {k}" for k in range(5)]
    texts += ["a Zebrafish without digits or address"] + [f"{far} study write {k}" for k in range(200)] + ["bob", "bob@y.org zebrafish@x.org"]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in pii.find_spans(df).collect()}
    n, n_e = len(texts), 10
    bare = [re.sub(PATTERNS["email"], " ", t) for t in texts]
    holds = [set(re.findall(r"[^\W\d_]{3,}", t.lower())) for t in bare]
    kinds = {}
    for term in set().union(*holds):
        both = sum(term in h for h, t in zip(holds, texts, strict=True) if "bob@x.org" in t)
        share = np.log2(both / sum(term in h for h in holds) / (n_e / n)) / np.log2(n / n_e) if both >= 3 else 0
        if share >= 0.8:
            kinds[term] = 5 if share >= 0.95 else 4
    assert kinds.keys() == {"zebrafish", "quagga"}  # quagga is always further away than 8 words
    for k, t in enumerate(texts):
        want = brute_spans(t)
        want += [(m.start(), kinds[m[0].lower()], m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in kinds and not any(a < m.end() and m.start() < b for a, _, b in brute_spans(t))]
        assert sorted(map(tuple, got[k if k != 3 else None].spans)) == sorted(want)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[10] == "a  without digits or address" and "quagga" not in clean[5]


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_disclosing_terms_count_distinct_texts(spark, broadcast_bytes):
    """Copies are one witness; a long run of letters is a term like any other; joined and broadcast terms give the same."""
    long = "q" * 100 + "é"
    texts = ["three copies tell of ann@x.org nothing"] * 3 + [f"{long} Wombat bob@y.org number {k} {'abcdefgh'[k] * 4}" for k in range(4)] + [f"number of days {'ijklmnop'[k % 8] * (4 + k)}" for k in range(60)] + [None, ""]
    texts += [texts[3]] * 5 + [f"again the {long.upper()} and wombat"]
    df = documents(spark, texts, _row_key=["clash"], _more=["clash"], _spans=["clash"], row_key=["clash"]).repartition(3)
    rule = pii.Disclosure(broadcast_bytes=broadcast_bytes)
    distinct = {t or "" for t in texts}
    holds = [({pii.term(w) for w in re.findall(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], " ", t))}, t) for t in distinct]
    kinds = {}
    for t in set().union(*(h for h, _ in holds)):
        for e in ("ann@x.org", "bob@y.org"):
            n_e, both, n_t = sum(e in x for _, x in holds), sum(e in x and t in h for h, x in holds), sum(t in h for h, _ in holds)
            share = np.log2(both / n_t / (n_e / len(holds))) / np.log2(len(holds) / n_e) if both >= 3 else 0
            if share >= 0.8:
                kinds[t] = max(kinds.get(t, 0), 5 if share >= 0.95 else 4)
    assert kinds.keys() == {"wombat", pii.term(long)}
    got = pii.find_spans(df, rule=rule).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[3 if r.doc_id is None else r.doc_id] or ""
        base = brute_spans(t)
        more = [(m.start(), kinds[pii.term(m[0])], m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t) if pii.term(m[0]) in kinds]
        assert sorted(map(tuple, r.base)) == base and list(map(tuple, r.spans)) == sorted(base + more)
    clean = pii.sanitise(df, rule=rule)
    assert clean.columns == df.columns
    out = {r.doc_id: r for r in clean.collect()}
    assert out[0].text == "three copies tell of [EMAIL] nothing" and out[0]._spans == out[0]._row_key == out[0]._more == "clash"
    assert len(out) == len(texts) and long not in out[4].text and "ombat" not in out[4].text and "Wombat" not in out[max(k for k in out if k)].text


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_pii_query(spark, tmp_path, monkeypatch, broadcast_bytes):
    """Every row of the query, over odd texts, names of two letters and numbers beside addresses of one domain or network."""
    monkeypatch.setattr(pii, "EVERY_WORD", pii.Disclosure(shortest=1, digits=True, broadcast_bytes=broadcast_bytes))
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "x", "1.2.3.4", "001.2.9.9", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", " ", "-", "é", "9" * 30, "漢字"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(200)] + ODD
    texts += [f"ref {k} 王五 acct 77123 mail u{k}@corp.example.org ok" for k in range(900, 905)] + [f"Zz host 172.16.{k}.9 {k}" for k in range(4)] + [f"mail ok acct host ref {k}" for k in range(100)]
    texts += [texts[-110]] * 9
    rows = [(k if k != 3 else None, t, "x", "y") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, base string, spans string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    distinct = {t or "" for t in texts}
    holds = []
    for t in distinct:
        base, bare = brute_spans(t), list(t)
        for a, _, b in base:
            bare[a:b] = "\0" * (b - a)
        names = {(k, t[a:b].lower()) for a, k, b in base} | {(0, t[a:b].lower().split("@")[1]) for a, k, b in base if k == 0} | {(1, tuple(map(int, t[a:b].split(".")[:2]))) for a, k, b in base if k == 1}
        whole = {m[0].lower() for m in re.finditer(r"[^\W_]+", t) if "\0" not in "".join(bare[m.start() : m.end()])}
        holds.append((whole, names))
    kinds = {}
    for e in set().union(*(n for _, n in holds)):
        with_e = [h for h, n in holds if e in n]
        for t in set().union(*with_e):
            both, n_t = sum(t in h for h in with_e), sum(t in h for h, _ in holds)
            share = np.log2(both / n_t / (len(with_e) / len(holds))) / np.log2(len(holds) / len(with_e)) if both >= 3 else 0
            if share >= 0.8:
                kinds[t] = max(kinds.get(t, 0), 5 if share >= 0.95 else 4)
    assert {"王五", "77123", "zz"} <= kinds.keys() and not {"mail", "ok", "acct", "host", "ref"} & kinds.keys()
    got = pii.op10_information_theoretic_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    said = lambda spans: ",".join(f"{pii.SPAN_KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for r in got:
        t = texts[3 if r.doc_id is None else r.doc_id] or ""
        base = brute_spans(t)
        more = [(m.start(), kinds[m[0].lower()], m.end()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in kinds and not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest() and r.spans == said(sorted(base + more))


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


# --- n-gram Jaccard join


def brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.add((j, i))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(sets))], links


def near_copies(rng):
    texts = ["", " \t\n", "one", "One two", "one two", "É one two three four five six"] + ["shared words stand in all of these texts " * 3 + prose(rng, 5) for _ in range(12)]
    for _ in range(12):
        base = prose(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
            base = w if rng.random() < 0.5 else base  # chains, whose ends don't link
    return texts + ["last copy of all these many words here"] * 9


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60), (1, 50)])
def test_jaccard_groups(spark, k, percent):
    texts = near_copies(random.Random(k * percent))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(3)
    sets, root, links = brute_groups(texts, k, percent)
    got = {r.doc_id: r for r in jaccard.groups(df, rule=jaccard.Rule(k, percent)).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(s), r) for s, r in zip(sets, root, strict=True)]
    if (k, percent) in ((3, 90), (2, 60)):
        pairs, member = jaccard.join(df, rule=jaccard.Rule(k, percent))
        of = defaultdict(set)
        for r in member.collect():
            of[r.class_id].add(r.doc_id)
        found = {tuple(sorted((a, b))) for p in pairs.collect() for a in of[p.class_a] for b in of[p.class_b]}
        assert found == {(i, j) for i, j in links if sets[i] != sets[j]}
        kept = {r.doc_id for r in jaccard.one_of_each(df, rule=jaccard.Rule(k, percent)).collect()}
        assert kept == set(root)


def test_jaccard_of_a_hot_pivot(spark, monkeypatch):
    """Many classes beside one pivot, dealt to parts; pairs among them that only their differences from the pivot decide."""
    monkeypatch.setattr(jaccard, "DEALT", 4)
    called = []
    monkeypatch.setattr(jaccard, "derived", lambda pairs, sets, own=jaccard.derived: (called.append(1), own(pairs, sets))[1])
    rng = random.Random(21)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(70):
        w = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            w[k] = f"x{rng.randrange(12)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, _row string").repartition(3)
    sets, root, links = brute_groups(texts, 2, 85)
    pairs, member = jaccard.join(df, rule=jaccard.Rule(2, 85))
    of = defaultdict(set)
    for r in member.collect():
        of[r.class_id].add(r.doc_id)
    found = {tuple(sorted((a, b))) for p in pairs.collect() for a in of[p.class_a] for b in of[p.class_b]}
    assert found == {(i, j) for i, j in links if sets[i] != sets[j]} and called
    kept = jaccard.one_of_each(df, rule=jaccard.Rule(2, 85)).collect()
    assert {r.doc_id for r in kept} == set(root) and {r._row for r in kept} == {"clash"}


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (5, "a b c d"), (5, "a b c d"), (7, "a b c d"), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(df, rule=jaccard.Rule(3, 90)).collect()), key=str)
    assert got == sorted([(True, None, 2, 5), (True, None, 0, None), (False, 5, 2, 5), (False, 5, 2, 5), (False, 7, 2, 5), (False, 8, 0, 8)], key=str)
    assert sorted(jaccard.one_of_each(df, rule=jaccard.Rule(3, 90)).select("doc_id").toPandas()["doc_id"].fillna(-1).astype(int)) == [-1, 5, 8]
    assert jaccard.groups(df.limit(0)).count() == 0


def test_word_hashes_follow_words():
    texts = pa.array(["ab c", None, "", "ab", " AB\vc ", "c\u00a0d"])
    hashes, counts = jaccard.words_of(texts)
    assert counts.tolist() == [2, 0, 0, 1, 2, 1]
    assert hashes[0] == hashes[2] == hashes[3] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 3


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.RandomState(11)
    pool = rng.randint(0, 2**62, 9000).astype(np.uint64)
    for n in (3, 400, 600, 1100, 5000):
        a, b = np.unique(pool[:n]), np.unique(pool[n // 20 : n + n // 20])
        x, y = jaccard.parities([a, b])
        words = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, words), axis=0) for v in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        narrow = [np.bitwise_xor.reduce(v.reshape(-1, jaccard.PARITY_WORDS), axis=0) for v in (x, y)]
        assert np.bitwise_count(narrow[0] ^ narrow[1]).sum() <= len(np.setxor1d(a, b))


# --- neighbours


def brute_neighbours(rows, is_query, k):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, q in good:
        if is_query(i):
            near = sorted(((-float((v * q).sum()), j) for j, v in good if j != i and len(v) == len(q)))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_neighbours(spark):
    rng = np.random.RandomState(8)
    rows = [(i, (rng.normal(size=16) * rng.uniform(0.2, 3)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(i, rows[5][1]) for i in range(600, 640)]
    rows += [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] * 16), (704, [1.0, None]), (None, [1.0] * 16), (720, [1.0, 2.0]), (721, [3.0, 4.0]), (740, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, block_rows=200, query_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_neighbours(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, near in want.items():
        assert [r[0] for r in got[q]] == list(range(1, len(near) + 1))
        assert [r[1:] for r in got[q]] == sorted((r[1:] for r in got[q]), key=lambda x: (-x[1], x[0]))
        hits += len({r[1] for r in got[q]} & {j for j, _ in near})
        total += len(near)
        vectors = dict(rows)
        for _, j, s in got[q]:
            assert s == pytest.approx(float((np.array(vectors[q], float) * np.array(vectors[j], float)).sum()), abs=1e-12)
    assert hits / total >= 0.9
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- URLs


def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
    fits = [r for r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    rule = max(fits, key=len, default=None)
    return host, path, rule


def test_urls(spark):
    rng = random.Random(9)
    given = [None, "", "x", "http://", "HTTP://A.Example.ORG/es/1?x=/fr", "https://b.com/fr/2#a", "http://example.org?q", "http://example.org/en/12", "http://xexample.org/en/12", "://com/de/", "a://b://c.com/de/x"]
    given += [f"https://{rng.choice(['good', 'fine'])}{rng.randint(0, 99)}.org/news/{rng.randint(0, 9)}" for _ in range(150)]
    given += [f"http://{rng.choice(['spam', 'pills'])}{rng.randint(0, 99)}.com/de/{rng.randint(0, 9)}" for _ in range(150)]
    given += [f"https://fine{k}.net/news/{k}" for k in range(5)] + [f"http://spam{k}.net/de/{k}" for k in range(5)]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(given)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(got) == len(given)
    for k, u in enumerate(given):
        assert (got[k].host, got[k].path, got[k].rule) == plain_verdict(u), u
        if got[k].rule:
            assert got[k].verdict == urls.RULES[got[k].rule]
    assert [got[k].verdict for k in range(3)] == ["allow", "allow", got[2].verdict]
    n = len(given)
    assert [got[k].verdict for k in range(n - 10, n)] == ["allow"] * 5 + ["block"] * 5
    assert urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(df.limit(3), rules={}).collect()} == {"allow"}


def test_url_columns_clash(spark):
    """Columns with the operator's own names stay; pages that a rule decides are not joined with scores."""
    rows = [(k, f"http://{h}/p{k % 7}", "mine", k) for k, h in enumerate(["a.org", "b.com", "c.net", "x.example.org"] * 20)] + [(900, None, "mine", 1), (901, "", "mine", 2)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, _url string, _decided long"), {"org/": "allow", "com/": "block"})
    assert {"_url", "_decided", "verdict", "rule"} <= set(got.columns)
    found = {r.page_id: r for r in got.collect()}
    assert len(found) == len(rows) and all(found[r[0]]._url == "mine" and found[r[0]]._decided == r[3] for r in rows)
    assert {found[k].verdict for k in range(0, 80, 4)} == {"allow"} and {found[k].verdict for k in range(1, 80, 4)} == {"block"}


def test_url_score_is_the_models(spark):
    """Weights against counts made by hand."""
    labelled = [("ab.org/x", 1), ("ab.org/y", 1), ("zz.com/x", 0)]
    got = {r.gram: r.weight for r in urls.weights(spark.createDataFrame([*labelled, ("q1.net", None)], "url string, label int")).collect()}

    def grams(u):
        u = urls.PAD + re.sub("[^a-z0./-]", "~", re.sub("[0-9]", "0", u))
        return [u[i : i + 4] for i in range(len(u) - 3)]

    def p(gram, label):
        out = 1 / urls.SYMBOLS
        for k in range(4):
            context, last = gram[3 - k : 3], gram[3]
            after = [g[3] for u, x in labelled if x == label for g in grams(u) if g[3 - k : 3] == context]
            if after:
                out = (after.count(last) + len(set(after)) * out) / (len(after) + len(set(after)))
        return out

    for g in {g for u, _ in [*labelled, ("q1.net", 0)] for g in grams(u)}:
        assert got[g] == pytest.approx(np.log(p(g, 1)) - np.log(p(g, 0)), abs=1e-9)


# --- WARC


def test_warc(spark, tmp_path):
    rng = random.Random(10)
    big = "é" * 400_000
    html = [None, "", "short", "short", "long enough " * 20, "long enough " * 20, "long enough " * 20, big, big, "\r\n\r\nWARC/1.1\r\n" * 30] + [prose(rng, 50) for _ in range(20)]
    rows = [(k, f"http://x.org/{k} é\r\n", h, "clash") for k, h in enumerate(html)] + [(None, None, "y" * 200, "c"), (None, None, "y" * 200, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write_archives(df, f"file://{tmp_path}/archives", roll=100_000)
    got = warc.read_archives(manifest).orderBy("record_id", "chunk_no").collect()
    by = defaultdict(list)
    for r in got:
        by[r.record_id].append(r)
    first = {}
    for k, h in enumerate(html):
        raw = (h or "").encode()
        parts = by[str(k)]
        assert [r.chunk_no for r in parts] == list(range(len(parts))) and [r.is_last for r in parts] == [False] * (len(parts) - 1) + [True]
        assert parts[-1].payload_bytes == len(raw) and parts[-1].payload_digest == hashlib.sha256(raw).hexdigest()
        first_id = first.setdefault(raw, k) if len(raw) >= 100 else k
        assert (parts[-1].record_type, parts[-1].refers_to) == (("response", None) if first_id == k else ("revisit", str(first_id)))
        so_far = b""
        for r in parts if first_id == k else []:
            so_far += bytes(r.chunk)
            assert r.payload_digest == hashlib.sha256(so_far).hexdigest() and r.payload_bytes == len(so_far)
        assert first_id != k or so_far == raw
    assert max(len(p) for p in by.values()) > 3 and len(by[""]) == 2 and {r.record_type for r in by[""]} == {"response"}
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_damaged_archive_fails(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://x", "payload " * 40)], "page_id long, url string, html string")
    manifest = warc.write_archives(df, f"file://{tmp_path}/a")
    path = manifest.first().archive.removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data.replace(b"payload payload", b"payload PAYLOAD", 1))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(manifest).count()


# --- quotes


def test_quote_levels():
    text = "On Monday, Ann wrote:\n> Bob wrote:\n> > first line\n> second  LINE\n>\nmine >not a mark\n>>deep"
    assert quotes.levels(text) == [(2, "first line"), (1, "second  LINE"), (1, ""), (0, "mine >not a mark"), (2, "deep")]
    said, own, quoted = quotes.parse(text)
    assert said == "mine >not a mark" and len(own) == 1 and sorted(k for k, _ in quoted) == [1, 2, 2]
    assert quotes.paragraph_hash("A  b") == quotes.paragraph_hash(" a B ") and quotes.paragraph_hash(" \t") is None


def test_mail_of_odd_turns(spark):
    rows = [(1, 0, None, "first"), (1, 1, "user", "second"), (1, 2, "bot", "third")] + [(2, k // 2, "user", f"say {k // 2}") for k in range(8)]
    got = [tuple(r) for r in quotes.as_mail(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "turn", "text").collect()]
    assert len(got) == len(rows)
    texts = {(c, t): x for c, t, x in got}
    assert texts[1, 1] == " wrote:\n> first\n\nsecond" and texts[1, 2] == "user wrote:\n>  wrote:\n> > first\n> second\n\nthird"


def test_own_lines_like_quotes_stay(spark):
    own = "> my own marked line\nrest\n  >> and\n\\\\> this\nx wrote:"
    rows = [(1, 0, "a", own), (1, 1, "b", "x wrote:\n> like mail"), (1, 2, "c", "> my own marked line"), (1, 3, "d", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotes.link(quotes.as_mail(df), "msg", "conv_id", "turn", "text").collect()}
    assert [got[k].text for k in range(4)] == [r[3] for r in rows]
    assert [(got[k].parent, got[k].depth) for k in range(4)] == [(None, 0), (1 << 20, 1), ((1 << 20) + 1, 2), ((1 << 20) + 2, 3)]


def test_quotes_over_segments(spark, monkeypatch):
    """One paragraph that a long conversation repeats: the latest saying before the quote, in whichever segment."""
    monkeypatch.setattr(quotes, "SEGMENT", 8)
    rows = [(k, "s", k, "again and again" if k % 10 == 3 else f"> again and again\nanswer {k}" if k % 3 == 0 else f"own {k}") for k in range(90)]
    df = spark.createDataFrame(rows, "msg long, scope string, n int, text string")
    for order in ("n", "lpad(n, 4, '0')"):  # an order that is no number goes without segments
        got = {r.msg: r.parent for r in quotes.link(df.withColumn("n", F.expr(order)), "msg", "scope", "n", "text").collect()}
        assert got == {k: max([j for j in range(k) if j % 10 == 3], default=None) if k % 3 == 0 and k % 10 != 3 else None for k in range(90)}


def test_branching_mail_is_the_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(14)
    lines = ["yes", "No  way", "> marked", "thanks", "", "\\> odd", "see above", "SEE above"]
    rows = [(c, t, "u", "\n".join(rng.choice([*lines, f"own {c} {t}"]) for _ in range(rng.randint(0, 4))) if rng.random() < 0.95 else None) for c in range(30) for t in range(rng.randint(1, 14))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = quotes.op5_quotation_linking(spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({quotes.SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len({r[4] for r in want}) > 3


def test_quotes_link_threads(spark):
    rows = [
        (1, "x", 1, "question one\nwith two lines"), (2, "x", 2, "> question one\nanswer"), (3, "x", 3, "> > question one\n> answer\nthanks"), (4, "x", 4, "> with two lines\nother answer"),
        (5, "x", 5, "> gone message\n> > other answer\nreply to what is missing"), (6, "x", 6, "nothing quoted"), (7, "y", 9, "> question one\nanother scope"), (8, "x", 8, "> QUESTION   one\nquestion one"),
        (9, "x", 9, "> question one\nto the latest"), (None, "x", 10, "> answer\nno id"), (11, "x", None, "> answer\nno order"), (12, "x", 12, None), (13, "x", 13, "> thanks"),
    ]
    df = spark.createDataFrame(rows, "msg long, scope string, n int, text string").withColumn("root", F.lit("clash"))
    got = {(r.msg, r.n): r for r in quotes.link(df, "msg", "scope", "n", "text").collect()}
    assert len(got) == len(rows)
    parent = {m: got[m, n].parent for m, _, n, _ in rows if m}
    assert parent == {1: None, 2: 1, 3: 2, 4: 1, 5: 4, 6: None, 7: None, 8: 1, 9: 8, 11: None, 12: None, 13: 3}
    assert {m: (got[m, n].root, got[m, n].depth) for m, _, n, _ in rows if m} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 1), 5: (1, 2), 6: (6, 0), 7: (7, 0), 8: (1, 1), 9: (1, 2), 11: (11, 0), 12: (12, 0), 13: (1, 3)}
    assert got[3, 3].text == "thanks" and got[12, 12].text == "" and got[13, 13].text == ""
    assert quotes.link(df.limit(0), "msg", "scope", "n", "text").count() == 0


# --- helpers


def test_slices_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "bb", "c" * 100, "d"])], names=["t"])
    assert [s.num_rows for s in common.slices(batch, "t", 6)] == [3, 1, 1]
    assert list(common.slices(batch.slice(0, 0), "t")) == []
