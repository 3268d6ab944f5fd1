import hashlib
import random

from gridloom.llm import fuzzyhash as fh
from gridloom.llm import textkit as tk


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    r = random.Random(1)
    a = ["".join(r.choices("ABCab", k=r.randint(0, 64))) for _ in range(120)]
    b = ["".join(r.choices("ABCab", k=r.randint(0, 64))) for _ in range(120)]
    assert fh.edit_distances(a, b).tolist() == [distance(x, y) for x, y in zip(a, b, strict=True)]


def test_fingerprints_do_not_depend_on_neighbours():
    r = random.Random(2)
    texts = ["".join(r.choices("abcdefgh \n", k=r.choice([0, 1, 6, 7, 8, 100, 3000, 50_000]))).encode() for _ in range(40)]
    assert fh.fingerprints(texts) == [fh.fingerprints([t])[0] for t in texts]
    near = fh.fingerprints([b"", b""])
    assert near == ["3::", "3::"] and fh.likeness(near, near).tolist() == [1.0, 1.0]


def test_an_edit_stays_near_and_another_text_does_not():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=600)) for _ in range(30)]
    edited = [t[:1500] + "XYZ" + t[1500:] for t in texts]
    a, b = fh.fingerprints([t.encode() for t in texts]), fh.fingerprints([t.encode() for t in edited])
    assert fh.likeness(a, b).min() > 0.8 and fh.likeness(a, a[1:] + a[:1]).max() < 0.3


def plain_fingerprint(text):
    """Byte by byte: the rolling hash, the block size, and a letter for each chunk."""
    m32, m64 = (1 << 32) - 1, (1 << 64) - 1
    if not text:
        return "3::"
    rolled = []
    for i in range(len(text)):
        h = 0
        for back in range(min(fh.WINDOW, i + 1)):
            c = int(fh._CODE[text[i - back]])
            h ^= (c << 4 * back | c >> (32 - 4 * back)) & m32 if back else c
        h = (h ^ h >> 16) * 0x7FEB352D & m32
        h = (h ^ h >> 15) * 0x846CA68B & m32
        rolled.append((h ^ h >> 16) + 1)
    block = 3
    while block * 64 < len(text):
        block *= 2
    ends = lambda size: [i + 1 for i, h in enumerate(rolled) if h % size == 0]
    while block > 3 and len(ends(block)) < 32:
        block //= 2

    def letters(size):
        cuts = ends(size)[:63]
        cuts += [len(text)] if not cuts or cuts[-1] < len(text) else []
        out = ""
        for a, b in zip([0, *cuts], cuts, strict=False):
            h = 0
            for c in reversed(text[a:b]):
                h = (h * tk._MULTIPLIER + int(tk._BYTE_CODE[c])) & m64
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m64
            h = (h ^ h >> 27) * 0x94D049BB133111EB & m64
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(h ^ h >> 31) & 63]
        return out

    return f"{block}:{letters(block)}:{letters(2 * block)}"


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (m, *a), (n, *b) = x.split(":"), y.split(":")
    m, n, best = int(m), int(n), 0.0
    for i, j in ((0, 0), (1, 1), (0, 1), (1, 0)):
        one, two = a[i], b[j]
        if m * (1 + i) == n * (1 + j) and any(one[k : k + 4] in two for k in range(len(one) - 3)):
            best = max(best, 1 - distance(one, two) / max(len(one), len(two)))
    return best


def test_fingerprints_and_likeness_are_those_of_plain_loops():
    r = random.Random(12)
    words = ["".join(r.choices("abcdéfghij", k=5)) for _ in range(60)]
    texts = ["", "a", "aaaaaaaa" * 200, "ab" * 700, *(" ".join(r.choices(words, k=r.choice([1, 5, 40, 150, 700]))) for _ in range(25))]
    texts += [t[: len(t) // 2] + "another end of it" for t in texts]
    prints = fh.fingerprints([t.encode() for t in texts])
    assert prints == [plain_fingerprint(t.encode()) for t in texts]
    pairs = [(r.choice(prints), r.choice(prints)) for _ in range(250)] + list(zip(prints, prints[len(prints) // 2 :], strict=False))
    found = fh.likeness(*map(list, zip(*pairs, strict=True)))
    assert [round(x, 12) for x in found] == [round(plain_likeness(x, y), 12) for x, y in pairs] and len(set(found.tolist())) > 10


def test_large_ids_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(fh, "RANGE_ROWS", 20)
    rows = [(2**62 + i, f"text {i}") for i in range(400)]
    dealt = fh.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r["count"] for r in dealt.filter("not copy").groupBy("part").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 40
    assert [tuple(x) for x in fh.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == plain(rows)


def plain(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        prints = fh.fingerprints([t.encode() for t in (text, edited, after)])
        near = fh.likeness([prints[0]] * 2, prints[1:])
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], near[0], near[1]))
    return out


def test_each_row_meets_the_next(spark, messy, none, monkeypatch):
    monkeypatch.setattr(fh, "RANGE_ROWS", 20)
    r = random.Random(5)
    rows = [(i * 3 % 211, "".join(r.choices("abcé \n", k=r.randint(0, 300)))) for i in range(211)]
    key = lambda x: (x[0] is not None, x[0] or 0, x[2])
    for table in (rows, rows[:1], rows[:2], [(x.doc_id, x.text) for x in messy.collect()]):
        got = [tuple(x) for x in fh.compare_with_edited(spark.createDataFrame(table, "doc_id long, text string")).collect()]
        assert sorted(got, key=key) == sorted(plain(table), key=key)
    assert fh.compare_with_edited(none).count() == 0
    assert fh.fingerprint_documents(messy).count() == messy.count()


def test_repeated_texts_get_enough_chunks():
    r = random.Random(7)
    for _ in range(40):
        passage = "".join(r.choices("abcdefghij ", k=40))
        block, letters, _ = fh.fingerprints([(passage * 120).encode()])[0].split(":")
        assert len(letters) >= fh.LETTERS // 2 or int(block) == fh.LEAST_BLOCK
    texts = [("".join(r.choices("abcdefghij ", k=80)) * 50).encode() for _ in range(20)]
    own, cut = fh.fingerprints(texts), fh.fingerprints([t[: len(t) // 2] + b"another end" for t in texts])
    assert fh.likeness(own, cut).min() > 0 and max(fh.likeness([own[0]] * 19, own[1:])) < 1
