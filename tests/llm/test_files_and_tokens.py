"""Tokenisation, packing, token files, WARC, URL filter and PII against round trips and brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, documents, edge_docs, empty_docs, rows
from tests.oracle import compare
from tidelog.llm import packing, pii, tokenfile, urls, warc
from tidelog.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from tidelog.llm.tokens import WordTokenizer

ODD = ["", None, "a  b's Don't É'S ñ ΑΣ Σ İx ﬁ 中文字 a b\u00a0c\u3000d ́e é <|endoftext|>x ### 12ab 3.5 it's'll ½ ² x² ªº ß ẞ \x00\x01 a\x1cb \x85z", "abc'd abc' 'abc a'", "ÀÖØöøÿ ×÷", "\u200b \ufeffa\u200db", "x" * 500, "'s's't"]


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(tokenizer_file())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_tokenizer_equals_the_library(spark, sf, direct):
    texts = ODD + [r["text"] for r in documents(spark, sf).collect()]
    for size in (2, 800_000):
        tok = WordTokenizer(tokenizer_file(), size)
        some = texts if size > 2 else texts[:12]
        ids, bounds = tok.encode(pa.array(some, pa.string()))
        for i, x in enumerate(some):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == direct(x), x


def test_tokenizer_equals_the_library_on_random_text(direct):
    r = random.Random(11)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x600, 0x700), (0x2000, 0x2070), (0x3000, 0x3100), (0x4E00, 0x4F00), (0xFB00, 0xFB50), (0x1F600, 0x1F640), (0, 0x20)]
    texts = ["".join(chr(r.randrange(*r.choice(ranges))) if r.random() < 0.7 else " " for _ in range(r.randrange(1, 60))) for _ in range(1500)]
    texts.append("zé 中x' " * 200_000)  # a very long text
    ids, bounds = WordTokenizer(tokenizer_file()).encode(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == direct(x), x[:100]


@pytest.mark.parametrize("size", [1, 3, 50, 400_000])
def test_tokenizer_forgets_words_and_still_equals_the_library(direct, size):
    r = random.Random(size)
    bits = [*"abcABCéÉßñÿÀ×÷µºªİſ'.,!?<>|$%&#*@-_019 \t\n\x0b\x1c\x85", "中", "и", "\u0301", "\u00a0", "\u3000", "'s", "'ll", "don't", "<|endoftext|>", "z" * 70]
    tok = WordTokenizer(tokenizer_file(), size)
    for _ in range(60):
        texts = [None if r.random() < 0.1 else "".join(r.choices(bits, k=r.randrange(50))) for _ in range(20)]
        ids, bounds = tok.encode(pa.array(texts, pa.string()))
        for i, x in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == direct(x), x
        for kept in (tok.words, tok.pieces):
            assert len(kept.strings) <= size and len(kept.ids) == kept.each.sum()
            assert all(len(w.encode()) <= 64 for w in kept.strings.to_pylist())


def ids_of(direct, text):
    return np.array([*direct(text), 2], "<u4")


def check_packing(got, docs, direct):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    want = [(d["doc_id"], ids_of(direct, d["text"])) for d in docs]
    expect = sorted(((i, at, min(4096, len(x) - at), zlib.crc32(x[at : at + 4096].tobytes()), len(x)) for i, x in want for at in range(0, len(x), 4096)), key=repr)
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=repr) == expect
    return sum(e[2] for e in expect), len(by_sequence)


def test_packing(spark, sf, direct):
    docs = documents(spark, sf)
    tokens, sequences = check_packing(QUERIES["op9_best_fit_packing"](spark, sf).collect(), docs.collect(), direct)
    assert sequences <= tokens / 4096 * 1.06 + 1
    odd = edge_docs(spark)
    check_packing(packing.pack_documents(clashing(odd), tokenizer_file()).collect(), odd.collect(), direct)
    assert packing.pack_documents(empty_docs(spark), tokenizer_file()).collect() == []
    many = packing.pack(packing.cut(docs, tokenizer_file()), shard_pieces=40).collect()
    check_packing(many, docs.collect(), direct)


def test_packing_keeps_large_ids_beside_a_null(spark, direct):
    big = 1 << 53
    docs = spark.createDataFrame([(None, "a b"), (big + 1, "a b"), (big + 3, "c"), (-big - 1, None), *[(None, "x")] * 300], "doc_id long, text string")
    out = packing.pack(packing.cut(docs, tokenizer_file()), shard_pieces=40)
    check_packing(out.collect(), docs.collect(), direct)
    assert {big + 1, big + 3, -big - 1} < {r["doc_id"] for r in out.collect()}
    assert out.groupBy(F.shiftright("sequence_id", 32).alias("s")).count().agg(F.max("count")).first()[0] < 120  # repeated rows are spread


def test_best_fit_against_brute_force():
    r = random.Random(1)
    for window in (7, 64, 4096):
        lengths = sorted((r.randint(1, window) for _ in range(400)), reverse=True)
        which, offsets = packing.best_fit_decreasing(lengths, window)
        room = []
        for n, w, o in zip(lengths, which, offsets, strict=True):
            fits = [x for x in room if x >= n]
            assert (window - o == min(fits)) if fits else (w == len(room) and o == 0)
            if w == len(room):
                room.append(window)
            assert room[w] == window - o
            room[w] -= n


def test_token_files(spark, sf, direct):
    docs = documents(spark, sf).collect()
    got = rows(QUERIES["op8_rans_token_files"](spark, sf), "doc_id", "start", "n_tokens", "ids_crc32")
    at, want = 0, []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = ids_of(direct, d["text"])
        want.append((d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want, key=repr)


def test_token_files_edges(spark, direct):
    odd = edge_docs(spark)
    manifest, freq = tokenfile.write_token_files(clashing(odd), tokenizer_file(), file_ids=20)
    assert manifest.count() > 3
    got = tokenfile.read_token_files(manifest, freq, read_ids=9000).orderBy("start").collect()
    order = sorted(odd.collect(), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, d["text"] is not None, d["text"] or ""))
    at = 0
    for g, d in zip(got, order, strict=True):
        ids = ids_of(direct, d["text"])
        assert tuple(g) == (d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    manifest, freq = tokenfile.write_token_files(empty_docs(spark), tokenizer_file())
    assert tokenfile.read_token_files(manifest, freq).collect() == []


def test_rans_blocks_and_damage(tmp_path):
    r = np.random.default_rng(0)
    for symbols, n in ((1, 1), (1, 500), (3, 33), (49408, 5), (2, tokenfile.BLOCK), (1000, tokenfile.BLOCK * 3 + 17)):
        ids = np.minimum(r.geometric(min(1, 3 / symbols), n) - 1, symbols - 1).astype(np.uint32)
        table = tokenfile.build_table(tokenfile.quantize(np.bincount(ids, minlength=symbols)))
        lengths = [n // 2, n - n // 2]
        data = b"".join(tokenfile.file_bytes(ids, [None, 7], lengths, table))
        path = tmp_path / "x.rans"
        path.write_bytes(data)
        with tokenfile.TokenFile(str(path), table) as f:
            assert (f.doc_ids, f.lengths.tolist()) == ([None, 7], lengths)
            for a, b in ((0, n), (n // 2, n), (n // 3, n // 3 + 1)):
                assert np.concatenate([*f.spans(a, b), np.empty(0, np.uint32)]).tolist() == ids[a:b].tolist()
    path.write_bytes(data[:300] + bytes([data[300] ^ 255]) + data[301:])
    with tokenfile.TokenFile(str(path), table) as f, pytest.raises(ValueError, match="checksum"):
        list(f.spans(0, n))
    path.write_bytes(data[:-1])
    with pytest.raises(ValueError):
        tokenfile.TokenFile(str(path), table)
    entropy = -sum(p * np.log2(p) for p in np.bincount(ids) / n)
    assert len(data) * 8 < n * entropy * 1.05 + 8000


def test_warc_matches_sql(spark, sf):
    compare(QUERIES["op7_warc_round_trip"](spark, sf), ORACLE_SQL["op7_warc_round_trip"], sf)


def pages(spark):
    big = "é" * 700
    inside = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>" * 30
    data = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", inside), (8, "u", inside), (8, "u", inside), (None, "u", big), (None, "u", "q" * 2000), (9, "u", "\x1f\x8b\x08" * 500)]
    return spark.createDataFrame(data, "page_id long, url string, html string"), data


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("block", [200, 4 << 20])
def test_warc_edges(spark, compress, block):
    df, data = pages(spark)
    files = warc.write_warc(clashing(df), compress=compress, file_bytes=4000)
    got = rows(warc.digest(warc.read_warc(files, block)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    groups = defaultdict(list)
    for i, _, h in data:
        if len((h or "").encode()) >= 1000:
            groups[h].append(i)
    want = []
    for i, _, h in data:
        raw = (h or "").encode()
        top = max((x for x in groups.get(h, []) if x is not None), default=None)
        again = top is not None and i != top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=repr)


def test_warc_empty_and_broken(spark, tmp_path):
    df, _ = pages(spark)
    assert warc.read_warc(warc.write_warc(df.limit(0))).collect() == []
    raw = warc.record_bytes("response", 1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    (tmp_path / "x.warc").write_bytes(raw + raw[:-2])
    files = spark.createDataFrame([(str(tmp_path / "x.warc"), 2 * len(raw) - 2)], "path string, size long")
    with pytest.raises(ValueError, match="does not reach"):
        warc.read_warc(files).collect()


def test_urls_match_sql(spark, sf):
    compare(QUERIES["op10_url_filter"](spark, sf), ORACLE_SQL["op10_url_filter"], sf)


@pytest.mark.parametrize("broadcast", [0, 1 << 21])
def test_urls_edges(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", broadcast)
    long = "http://example.com/en/7" + "x/" * 300_000
    data = ["http://A.Example.COM/en/77?x", "https://example.com/en/8", "http://com/en/", "http://notcom/en/", "x://y.net/de/8", "ftp://example.net/de/81#z", None, "", "no scheme/en/", "http://", "http://x.org/es", "http://x.org/es/?http://b.com/en/", "://a.com/en/", "http://.com/en/", "http://a..com/en/", "http://É.com/en/", "http://com?/en/", "http://example.com/en/77://com/", "http://all.io", "http://a.all.io?q", "http://ab/", long, "http://" + "a." * 2000 + "com/en/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(data)] + [(0, data[0]), (None, data[1])], "page_id long, url string")
    listed = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("x.org", "/es/", "allow"), ("x.org", "/es/", "block"), (None, "/", "block"), ("all.io", "", "block"), ("a", "b/", "block"), ("com/en", "/", "block")]
    got = rows(urls.judge(clashing(df), spark.createDataFrame(listed, "host string, path string, verdict string")), "page_id", "host", "path", "rule", "verdict")
    want = []
    for i, u in [(i, u) for i, u in enumerate(data)] + [(0, data[0]), (None, data[1])]:
        m = re.search("://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), v, h + p) for h, p, v in listed if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        want.append((i, host, path, best[2], best[1]))
    assert got == sorted(want, key=repr)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urls.judge(df, none).collect()} == {"allow"}
    assert urls.judge(df.limit(0), none).collect() == []


def test_urls_long_list(spark):
    """Thousands of listed URLs, many under one host: each page gets its longest."""
    r = random.Random(2)
    listed = [(f"h{r.randrange(400)}.org", "/" + "p" * r.randrange(40) + "/", r.choice(["allow", "block"])) for _ in range(3000)] + [("hot.org", "/" + "q" * k + "/", "block") for k in range(200)]
    pages = [(i, f"http://{r.choice(['', 'www.', 'a.b.'])}{h}{p}{r.choice(['', 'x', 'pp/'])}") for i, (h, p, _) in enumerate(r.choices(listed, k=400))] + [(1000 + k, f"http://other{k}.net/p/") for k in range(100)]
    got = rows(urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(listed, "host string, path string, verdict string")), "page_id", "rule", "verdict")
    want = []
    for i, u in pages:
        host, path = re.fullmatch("http://([^/]*)(/.*)", u).groups()
        best = max(((len(h + p), v, h + p) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, "allow", None))
        want.append((i, best[2], best[1]))
    assert got == sorted(want, key=repr)


PII = [
    (1, "Mail Bob.12@Mail1.example.com or bob.12@mail1.example.com, call +1 (988) 555-2485 or 988-555-2485."),
    (2, "Card 4539 1488 0343 6467 and 4539148803436467; ip 10.20.30.40. ssn 123-45-6789!! Mrs. Anna Smith met Mr Smith and Frau SMITH."),
    (3, None), (4, ""), (5, "nothing here, 12 and 3.5"), (6, "г-жа Анна Иванова и г-н Иванов"), (7, "4547628009837467### 42.144.35.254, x@y.co"), (7, "x@y.co"), (None, "x@y.co"), (8, "v 1.2.3.4.5 999.1.1.1 12345678901234567890123"),
]


def test_pii(spark):
    df = spark.createDataFrame(PII, "doc_id long, text string")
    out = {(r["doc_id"], k): r["text"] for k, r in enumerate(pii.replace(clashing(df), "k").collect())}
    by = lambda i: [t for (j, _), t in sorted(out.items(), key=lambda x: x[0][1]) if j == i]
    one = by(1)[0]
    mail = re.fullmatch(r"Mail (\S+@\S+) or (\S+@\S+), call \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4})\.", one)
    assert mail and mail[1] == mail[2] != "bob.12@mail1.example.com" and mail[1].endswith(".example.org") and (mail[3], mail[4]) == (mail[5], mail[6]) != ("988", "555-2485")
    two = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}); ip (\d+\.\d+\.\d+\.\d+)\. ssn (9\d{2}-\d{2}-\d{4})!! Mrs\. ([A-Z][a-z]+) ([A-Z][a-z]+) met Mr ([A-Z][a-z]+) and Frau ([A-Z]+)\.", by(2)[0])
    assert two and two[1].replace(" ", "") == two[2] and two[2][0] == "4" and two[2] != "4539148803436467" and two[6] == two[7] == two[8].title() != "Smith" and two[5].endswith("na")
    luhn = lambda d: sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d)) % 10
    assert luhn("4539148803436467") == luhn(two[2]) == 0
    assert by(3) == [None] and by(4) == [""] and by(5) == [PII[4][1]] and by(8) == [PII[9][1]]
    assert re.fullmatch(r"г-жа [А-Я][а-я]+на [А-Я][а-я]+ва и г-н [А-Я][а-я]+р", by(6)[0])
    assert by(7)[0].split(", ")[1] == by(7)[1] == by(None)[0]
    assert re.fullmatch(r"\d{16}### \d+\.\d+\.\d+\.\d+, \S+@\S+", by(7)[0])
    other = pii.replace(df, "another").where("doc_id = 1").first()["text"]
    assert other != one
    assert pii.replace(df.limit(0), "k").collect() == []


def test_pii_card_groupings_and_international_phones(spark):
    cards = ["3056 930902 5904", "41111111 11111111", "4111 1111 1111 1", "4111 1111 1111 1111 123", "4539-1488-0343-6467", "3782 822463 10005", "411111 1111111111 11", "4539148803436467"]
    phones = ["+49 30 1234567", "+33 1 23 45 67 89", "+34 612 345 678", "+15551234567", "+49 (0)30/1234567", "+44 20 7946 0958", "+1 (988) 555-2485", "+33\u00a01\u00a023\u00a045\u00a067\u00a089"]
    phones += ["0049 30 1234567", "001 988 555 2485", "01 23 45 67 89", "020 7946 0958", "030/1234567", "+44 988 555 2485"]
    country = [3, 3, 3, 2, 3, 3, 2, 3, 4, 3, 1, 1, 1, 3]
    left = ["2026-11-26 12:42", "01-02-2026", "0123-4567", "007 100", "+5 or +1234", "1 2 3 4 5 6", "12345678 9012"]
    run = "id 12345 4539 1488 0343 6467 end, 3056 930902 5904 4539 1488 0343 6467"
    texts = [f"x {t}, y" for t in cards + phones + left] + [run, "(555) 123-4567"]
    got = [r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "k").orderBy("doc_id").collect()]
    shape = lambda t: re.sub("[0-9]", "9", t)
    for t, g in zip(texts, got, strict=True):
        assert shape(t) == shape(g)
    for t, g in zip(cards, got, strict=False):
        a, b = re.sub("[^0-9]", "", t), re.sub("[^0-9]", "", g)
        assert a[0] == b[0] and a[-6:] != b[-6:] and sum(x == y for x, y in zip(a, b, strict=True)) < 10, (t, g)
    for t, g, n in zip(phones, got[len(cards) :], country, strict=False):
        assert g[2 : 2 + n] == t[:n] and re.sub("[^0-9]", "", g)[-6:] != re.sub("[^0-9]", "", t)[-6:], (t, g)
    assert got[len(cards) + len(phones) : -2] == texts[len(cards) + len(phones) : -2]
    assert "4539 1488 0343 6467" not in got[-2] and "3056 930902 5904" not in got[-2] and "0343" not in got[-2]
    digits = lambda g: re.sub("[^0-9]", "", g)
    assert digits(got[-1]) == digits(got[len(cards) + 3])[1:]  # spellings of one number
    at = {p: digits(got[len(cards) + k]) for k, p in enumerate(phones)}
    assert at["+33 1 23 45 67 89"] == at["+33\u00a01\u00a023\u00a045\u00a067\u00a089"] and at["0049 30 1234567"] == "00" + at["+49 30 1234567"]
    assert at["+1 (988) 555-2485"][1:] == at["001 988 555 2485"][3:] != at["+44 988 555 2485"][2:]  # another country, another number


def test_pii_names_with_a_title_or_a_listed_given_name(spark):
    texts = ["Anna Smith met Mrs. Anna Smith, Robert Smith and Mr Robert.", "Then Elena Petrova wrote.", "Анна Иванова", "Susanna Smith; Anna smith; anna Smith; The Smith", "JOHN Smith, John SMITH"]
    got = [r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "k").orderBy("doc_id").collect()]
    one = re.fullmatch(r"([A-Z]\w+na) ([A-Z]\w+) met Mrs\. (\w+) (\w+), ([A-Z]\w+n) (\w+) and Mr (\w+)\.", got[0])
    assert one and (one[1], one[2]) == (one[3], one[4]) != ("Anna", "Smith") and one[6] == one[2] and "Robert" not in got[0]
    assert re.fullmatch(r"Then \w+na \w+ wrote\.", got[1]) and "Elena" not in got[1] and re.fullmatch(r"[А-Я][а-я]+на [А-Я][а-я]+ва", got[2])
    assert got[3] == texts[3] and got[4].startswith("JOHN Smith, ") and got[4].split()[-1].isupper() and "SMITH" not in got[4]


def brute_entities(text):
    """The numbers and addresses of a text, found apart from the operator, in the corpus's shapes."""
    shapes = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]\.[A-Za-z]{2,}", "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", "card": r"(?<![0-9])[0-9]{16}(?![0-9])", "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"}
    return [(kind, m) for kind, shape in shapes.items() for m in re.findall(shape, text or "")]


def test_pii_query_against_brute_force(spark):
    """On the corpus: every entity found apart is replaced, alike wherever it stands, distinct from all others and from all real ones; the rest stays."""
    sf = "/root/testdata/sf0.01"
    before = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    extra = {10**6 + k: f"ssn {100 + k}-12-{3000 + k} x" for k in range(40)}
    df = documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    before |= extra
    after = {r["doc_id"]: r["text"] for r in pii.replace(df, "k").collect()}
    assert set(before) == set(after)
    given, real = {}, {e for t in before.values() for e in brute_entities(t)}
    for i, t in before.items():
        found, made = brute_entities(t), brute_entities(after[i])
        assert len(found) == len(made) and not set(made) & real
        for a, b in zip(found, made, strict=True):
            assert a[0] == b[0] and given.setdefault(a, b) == b
        if not found:
            assert after[i] == t
    lowered = {(k, m.lower()) for k, m in given}
    assert len(given) > 60 and len({v for v in given.values()}) == len(lowered)


def test_pii_draws_are_not_real(spark, monkeypatch):
    """A draw that is another entity of the input is drawn again."""
    plain = pii.surrogate
    near = lambda key, e, attempt: F.when(e["kind"] == "ip", F.concat(F.lit("10.0.0."), (F.substring(e["id"], 8, 3).cast("int") + 1 + attempt).cast("string"))).otherwise(plain(key, e, attempt))
    monkeypatch.setattr(pii, "surrogate", near)
    df = spark.createDataFrame([(k, f"at 10.0.0.{10 + k} x") for k in range(5)], "doc_id long, text string")
    made = {r["text"].split()[1] for r in pii.replace(df, "k").collect()}
    assert len(made) == 5 and not made & {f"10.0.0.{10 + k}" for k in range(5)}


def test_pii_of_a_very_long_text(spark):
    text = "word " * 200_000 + "x@y.co " + "1" * 100_000 + " " + "a" * 100_000 + " " + "12 " * 50_000 + "+1 (988) 555-2485"
    out = pii.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()["text"]
    assert out[:1_000_000] == text[:1_000_000] and "x@y.co" not in out and not out.endswith("988) 555-2485") and len(out) > 1_300_000


def test_pii_surrogates_stay_distinct(spark, monkeypatch):
    """Names drawn from a tiny space collide at first; the check draws again, with the constant and with the join."""
    plain = pii.surrogate
    tiny = lambda key, e, attempt: F.when(e["kind"] == "ip", F.concat(F.lit("9.9.9."), (F.abs(F.hash(e["id"], attempt)) % 60).cast("string"))).otherwise(plain(key, e, attempt))
    monkeypatch.setattr(pii, "surrogate", tiny)
    monkeypatch.setattr(pii, "ATTEMPTS", 400)
    data = [(i, f"from 10.0.0.{i % 25} to 10.0.0.{(i + 1) % 25}") for i in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for inline in (5000, 0):
        monkeypatch.setattr(pii, "INLINE", inline)
        found = {}
        for r in pii.replace(df, "k").collect():
            a, b = re.fullmatch(r"from (\S+) to (\S+)", r["text"]).groups()
            i = r["doc_id"]
            assert found.setdefault(i % 25, a) == a and found.setdefault((i + 1) % 25, b) == b
        assert len(set(found.values())) == 25


def test_pii_query(spark, sf):
    before = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    after = {r["doc_id"]: r["text"] for r in QUERIES["op6_pii_surrogates"](spark, sf).collect()}
    assert set(before) == set(after)
    for i, t in before.items():
        found = re.findall(pii.EMAIL + "|" + r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])" + "|" + r"(?<![0-9])[0-9]{16}(?![0-9])" + "|" + r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", t)
        assert not any(x in after[i] for x in found)
        if not found:
            assert after[i] == t
