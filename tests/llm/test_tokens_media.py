import base64
import hashlib
import random
import zlib

import pyarrow as pa
import public_tokenizers as tokenizers
import pytest
import sentencepiece
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from samewise.llm import media_audio as audio
from samewise.llm import warc
from samewise.llm.sentencepieces import BPE, UNIGRAM, Encoder, PieceModel, encoded
from samewise.llm.token_counts import Counter, TokenTree, redactions, token_counts

ODD = ["", None, " ", "  a  b", "\n x \n\n  y ", "a\tb", "日本語 テスト ☃︎", "x" * 700, "ab " * 5 + "   ", "é ﬁ ­", "\x00\x01 q", "the" * 200, "😀😀 ok", "a　b", "mail a.b@c.de or 10.0.0.1 now", "don't we'll 's"]
MODEL = tokenizers.path("piece_bpe_32k.model")


def test_pieces_are_the_librarys(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = Encoder(PieceModel.load(MODEL))
    flat, bounds = encoder.ids(pa.chunked_array([pa.array(ODD)]))
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library.encode([t or "" for t in ODD])
    rows = encoded(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), MODEL).collect()
    assert all(r["round_trip"] for r in rows) and {r["doc_id"]: r["n_ids"] for r in rows} == {i: len(library.encode(t or "")) for i, t in enumerate(ODD)}


def test_viterbi_matches_brute_force():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", "bb"]
    scores = [0.0, -3.0, -2.0, -2.1, -2.5, -2.6, -3.2, -3.3, -4.05]
    model = PieceModel(pieces, scores, [2] + [1] * 8, UNIGRAM)
    value = dict(zip(pieces[1:], scores[1:], strict=True))

    def best(text):
        if not text:
            return 0.0, []
        found = []
        for n in range(1, len(text) + 1):
            if text[:n] in value or n == 1:
                s, rest = best(text[n:])
                found.append((s + value.get(text[:n], model.unknown_score), [pieces.index(text[:n]) if text[:n] in value else 0, *rest]))
        return max(found, key=lambda f: f[0])

    rnd = random.Random(1)
    units = ["▁" + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    flat, n = model.encode_units(units)
    at = 0
    total = lambda ids: sum(scores[i] if i else model.unknown_score for i in ids)
    for unit, k in zip(units, n, strict=True):
        ids = flat[at : at + k].tolist()
        at += k
        assert total(ids) == pytest.approx(best(unit)[0]) and "".join(pieces[i] if i else "c" for i in ids) == unit
    assert BPE != UNIGRAM


@pytest.fixture(scope="module")
def counter():
    return Counter(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def test_counts_follow_edits(counter):
    rnd = random.Random(2)
    for text in ODD + ["word number 12 and more. " * 60]:
        tree = TokenTree(text or "", counter)
        for _ in range(25):
            a = rnd.randint(0, len(tree.text))
            b = min(len(tree.text), a + rnd.choice([0, 1, 3, 30]))
            tree.edit(a, b, rnd.choice(["", " ", "a", "\n", "'s", "  \n ", "12", "é!"]))
            assert [p for block in tree.blocks for p in block] == counter.pattern.findall(tree.text)
            assert tree.total == counter.count(tree.text)


def test_few_pretokens_are_encoded_again(counter):
    tree = TokenTree("some words go here " * 500, counter)
    tree.edit(4000, 4005, "other")
    assert tree.encoded < 8


def test_token_counts(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in token_counts(df, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect():
        text = after = ODD[r["doc_id"]] or ""
        for a, b, new in reversed(redactions(text)):
            after = after[:a] + new + after[b:]
        assert (r["n_tokens"], r["n_tokens_after"]) == (len(whole.encode_ordinary(text)), len(whole.encode_ordinary(after)))


def test_audio_round_trip(spark):
    texts = ["", None, "a", "é" * 288, "x" * 577, "\x00ÿ" * 4000]
    rows = audio.audio_roundtrip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(audio.encode(raw)).hexdigest() and r["seconds"] == len(payload) / 16000
    features = {r["doc_id"]: r["feature"] for r in rows}
    assert features[0] == features[1] != features[5]


def test_audio_parser_finds_frames_again():
    data = audio.encode(b"q" * 3000)
    begin = audio.parse_tags(data)[0]
    broken = data[: begin + 648] + b"\xff\xf2junk\xff" + data[begin + 648 :] + b"TAG" + b"title".ljust(125, b"\0")
    stream = audio.parse(broken)
    assert len(stream.audio) == 6 and stream.skipped == 7 and stream.tags["title"] == "title" and stream.table["frames"] == 6
    assert audio.payload_of(broken, stream) == audio.padded(b"q" * 3000)
    flipped = bytearray(data)
    flipped[begin + 648 + 8] ^= 1
    s = audio.parse(bytes(flipped))
    assert (s.checked, s.broken) == (7, 1)
    assert not audio.parse(b"no audio \xff\xfb").frames and not audio.parse(b"").frames
    plain = b"".join(bytes([0xFF, 0xFB, 0x90 | pad << 1, 0x64]) + bytes(413 + pad) for pad in (0, 1, 0, 1))
    s = audio.parse(plain)
    assert [f.offset for f in s.frames] == [0, 417, 835, 1252] and s.seconds == pytest.approx(4 * 1152 / 44100)


def test_variable_bitrate_table():
    body = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (5000).to_bytes(4, "big") + (12).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (6).to_bytes(2, "big") + b"\x00\x10\x00\x20"
    frame = bytes([0xFF, 0xFB, 0x90, 0x64]) + bytes(32) + body
    data = frame.ljust(417, b"\0") + bytes([0xFF, 0xFB, 0x90, 0x64]) + bytes(413)
    s = audio.parse(data)
    assert s.table == {"kind": "VBRI", "frames": 12, "bytes": 5000, "toc": [48, 96], "per": 6} and len(s.audio) == 1


PAGES = [(3, "http://a/x", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (7, "http://c\r\nX: y", ""), (9, "u", "z" * 70000), (None, "n", "<p>é</p>"), (5, "v", "z" * 70000)]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    rows = {r["page_id"]: r for r in warc.warc_roundtrip(df, roll_bytes=600).collect()}
    first = {}
    for i, _, html in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", i)
    for i, _, html in PAGES:
        payload = (html or "").encode()
        refers = None if i is None or first[html or ""] == i else first[html or ""]
        r = rows[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if refers is not None else "response", refers)
    assert warc.warc_roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_frequent_payloads_and_clashing_columns(spark, monkeypatch):
    pages = [(i, f"http://h/{i}", ["", "x", f"p{i}"][min(2, i % 4)]) for i in range(5000)]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, key string, kind int")
    rows = {r["page_id"]: r["refers_to"] for r in warc.warc_roundtrip(df).collect()}
    assert rows == {i: (i % 4 if i % 4 < 2 and i > 3 else None) for i, _, _ in pages} | {0: None, 1: None}


def test_long_records_are_read_in_chunks(spark, tmp_path):
    rnd = random.Random(1)
    html = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3 << 20))
    df = spark.createDataFrame([(1, "u", html), (2, "v", "short")], "page_id long, url string, html string")
    manifest, folder = warc.write_archives(df, f"file://{tmp_path}/w", roll_bytes=1000)
    rows = {r["page_id"]: r["payload"] for r in warc.read_manifest(manifest, folder).collect()}
    assert bytes(rows[1]).decode() == html and bytes(rows[2]) == b"short"
    files = spark.read.format("binaryFile").load([f"{folder}/{r['name']}" for r in manifest.collect()])
    assert {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(files).collect()} == {i: bytes(x) for i, x in rows.items()}


def test_archives_are_deterministic_and_roll(spark, tmp_path):
    df = spark.createDataFrame(PAGES * 3, "page_id long, url string, html string")
    seen = []
    for k, parts in enumerate((2, 5)):
        manifest, folder = warc.write_archives(df.repartition(parts), f"file://{tmp_path}/{k}", roll_bytes=700, files=2)
        names = sorted(r["name"] for r in manifest.collect())
        seen.append([(n, (tmp_path / str(k) / n).read_bytes()) for n in names])
        assert len(names) > 2 and not [p for p in (tmp_path / str(k)).iterdir() if p.name.startswith(".part")]
    assert seen[0] == seen[1]
    assert sum(1 for _, data in seen[0] for f, _ in warc.records(data) if f["WARC-Type"] != "warcinfo") == len(PAGES) * 3


def test_odd_rows_of_each_operator(spark):
    """Empty tables, null ids, repeated rows, very long texts and columns named like the results."""
    from samewise.llm.media_audio import audio_roundtrip

    path, rnd = tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(7)
    long = " ".join(rnd.choice(["the", "mail", "a.b@c.de", "10.0.0.1", "wörd", "x" * 30]) for _ in range(60_000))
    rows = [(1, "some text"), (1, "some text"), (None, "some text"), (2, None), (3, ""), (4, long), (None, None)]
    named = ("n_tokens", "n_ids", "ids", "round_trip", "media", "payload_bytes", "n_bytes", "feature", "block", "length")
    df = spark.createDataFrame([(*r, *["c"] * len(named)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in named)).repartition(3)
    plain = df.select("doc_id", "text")
    for run in (lambda d: token_counts(d, path, tokenizers.PATTERN), lambda d: encoded(d, MODEL), audio_roundtrip):
        got = sorted(map(tuple, run(df).collect()), key=str)
        assert len(got) == len(rows) and got == sorted(map(tuple, run(plain).collect()), key=str)
        of = {}
        for r in got:
            of.setdefault(r[0], set()).add(r[1:])
        assert len(of[1]) == 1 and of[1] < of[None] and of[2] == of[3] and of[2] < of[None]  # equal texts, equal values
        assert run(df.where("false")).count() == 0
    counts = {r["doc_id"]: r for r in token_counts(df, path, tokenizers.PATTERN).where("doc_id is not null").collect()}
    encoder = tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    after = long
    for start, end, new in reversed(redactions(long)):
        after = after[:start] + new + after[end:]
    assert counts[4]["n_edits"] > 10_000 and (counts[4]["n_tokens"], counts[4]["n_tokens_after"]) == (len(encoder.encode_ordinary(long)), len(encoder.encode_ordinary(after)))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r["n_ids"] for r in encoded(df, MODEL).where("doc_id = 4").collect()} == {len(library.encode(long))}
