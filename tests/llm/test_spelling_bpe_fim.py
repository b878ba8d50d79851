"""Spelling variants, byte-level BPE and fill-in-middle against brute force, the tiktoken library and exact round trips."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rippleframe.llm import byte_bpe, fim, queries, spelling

DOCS = "doc_id long, text string, k string, t int, h int, ids int, node string, word string, n long, output int"
PATH = public_tokenizers.path(queries.BYTE_TOKENIZER)
TEXTS = [
    None, "", " ", "a", "it's we'll they're I'd 'tis x'", "''s '", "!'s", " 's\n's\t's", "a  b \n\n c   ", "　x y\x85z\x1cw", "1½٣x", "naïve Ünïcode 日本語 𝒳😀́",
    "<|endoftext|>", "<P>a", "x<S", "<M>", "z" * 30_000, "! " * 5_000, " " * 20_000 + "x", "ab1" * 9_000, "line\r\nline\n", "\x00",
]


@pytest.fixture(scope="module")
def docs(frame):
    def row(key, text):
        return key, text, "clash", 1, None, 2, None, "word", 3, 4

    rows = [row(k, t) for k, t in enumerate(TEXTS)]
    return frame([*rows, rows[4], rows[4], row(None, "null key's text"), row(None, None)], DOCS)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes_to_the_text(docs, library):
    rows = docs.select("doc_id", "text").collect()
    encoded = byte_bpe.encode(docs, PATH)
    assert encoded.columns == ["doc_id", "ids", "at"]
    got = sorted((str(r["doc_id"]), r["ids"], r["at"]) for r in encoded.collect())
    want = []
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        at = np.cumsum([0, *(len(library.decode_single_token_bytes(i)) for i in ids)])[:-1].tolist()
        want.append((str(r["doc_id"]), ids, at))
    assert got == sorted(want)
    decoded = byte_bpe.decode(encoded, PATH)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in decoded.collect()) == sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in rows)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_byte_bpe_works_in_small_slices():
    sizes = np.array([0, byte_bpe.SLICE_BYTES, 5, 3 * byte_bpe.SLICE_BYTES, 0, 7])
    assert list(byte_bpe.slices(sizes)) == [(0, 2), (2, 1), (3, 1), (4, 2)] and not list(byte_bpe.slices(sizes[:0]))
    assert byte_bpe.SLICE_BYTES <= 1 << 20 and not byte_bpe.Vocabulary(PATH).ranks


def test_bpe_query_gives_digests_of_the_library_ids(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in queries.read(spark, "/root/testdata/sf0.001", "documents").collect():
        ids, text = library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(text).hexdigest()


def test_pieces_of_random_texts_equal_the_pattern(library):
    rng = random.Random(4)
    parts = ["'", "'s", "'re", "'ll", "'v", "e", "l", "d", " ", "  ", "\n", "\t", "　", "é", "日", "1", "½", "!", "́", "😀", "\x1c", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20_000)]
    raw = [t.encode() for t in texts]
    ids, upto = byte_bpe.Vocabulary(PATH, byte_bpe.class_runs()).encode(b"".join(raw), np.cumsum([len(b) for b in raw]))
    assert [ids[a:b].tolist() for a, b in zip([0, *upto], upto)] == [library.encode_ordinary(t) for t in texts]


def test_scan_is_the_running_state_of_the_automaton():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 2 * byte_bpe.SYMBOLS, 3 * byte_bpe.BLOCK + 17)
    state, want = byte_bpe.BEGIN, []
    for s in symbols:
        state = byte_bpe.AFTER[byte_bpe.BEGIN if s >= byte_bpe.SYMBOLS else state, s % byte_bpe.SYMBOLS]
        want.append(state)
    assert byte_bpe.REACHED[byte_bpe.scan(byte_bpe.ELEMENT[symbols])].tolist() == want


def test_long_and_short_merges_agree(library):
    ranks, rng = library._mergeable_ranks, random.Random(3)
    for n in (2, 5, 60, 400):
        piece = "".join(rng.choices("abcdething ", k=n)).encode()
        assert byte_bpe._merge_short(piece, ranks) == byte_bpe._merge_long(piece, ranks)


def brute_fim(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("slice_bytes", [4_000_000, 50])
def test_fim_matches_brute_force_and_restores(docs, frame, monkeypatch, slice_bytes):
    monkeypatch.setattr(fim, "SLICE_BYTES", slice_bytes)
    more = frame([(100 + k, t, *[None] * 8) for k, t in enumerate([t for t in TEXTS if t and len(t) < 100] * 12)], DOCS)
    both = docs.union(more)
    out = fim.restore(fim.transform(both))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert out.columns == names
    got = sorted(map(repr, (tuple(r) for r in out.collect())))
    assert got == sorted(repr((r["doc_id"], *brute_fim(r["doc_id"], r["text"]), r["text"] or "")) for r in both.collect())
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(words):
    out, forms = {}, {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= 5 * n else None
        forms[w], out[w] = form, [form, None, n, len(others), -others[0][0] if form else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def test_variants_match_brute_force(frame):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcàÿ", k=rng.randint(6, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "abababab", "babababa", "q" * 90, "q" * 91, "qx" * 60, "qx" * 60 + "y"]
    words = set(base)
    for w in base:
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("abcàÿz")
            words.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
    counts = {w: rng.choice([5, 5, 6, 25, 30, 150, 900]) for w in words}
    got = spelling.variants(frame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == brute_variants(counts)
    assert len({(r["form"]) for r in got.collect()}) > 5


def test_walks_go_level_by_level_through_shared_paths(frame):
    # Two stems share all their endings, so no path is single before its last letter.
    counts = {f"{stem}{tail}": 5 + 50 * (stem == "stemma") for stem in ("stemma", "stemmb") for tail in ("rest", "resting", "rests", "rester", "restered")}
    got = spelling.variants(frame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == brute_variants(counts)


def test_no_words_and_single_words(frame):
    assert spelling.variants(frame([], "word string, n long")).count() == 0
    assert [tuple(r) for r in spelling.variants(frame([("lonely", 7)], "word string, n long")).collect()] == [("lonely", None, "lonely", 7, 0, None)]


def test_spelling_query_on_odd_documents(docs, frame, spark, tmp_path):
    texts = ["Naïve NAÏVE naïve strasse straße ÀÉÿ×÷ " * 9 + "word " * 999, "strasses strasse1strasse", "x" * 20_000]
    odd = docs.union(frame([(1000 + k, t, *[None] * 8) for k, t in enumerate(texts * 6)], DOCS))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for r in odd.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if r['doc_id'] is None else r['doc_id']}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert "x" * 20_000 in words
    assert {tuple(r) for r in queries.op11_spelling_variants(spark, str(tmp_path)).collect()} == brute_variants(words)
