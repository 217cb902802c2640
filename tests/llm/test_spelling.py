"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from lexspan.llm import spelling


def plain_words(rows, length=6, occurrences=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= length and n >= occurrences}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain(counts, times=5):
    form, near = {}, {}
    for word, n in counts.items():
        near[word] = [other for other in counts if other != word and one_apart(word, other)]
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= times * n else None
    rows = []
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        rows.append((word, form[word], root, n, len(near[word]), counts.get(form[word])))
    return sorted(rows)


def corpus():
    pick = random.Random(17)
    stems = ["".join(pick.choices("abcéÿ", k=pick.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "×÷×÷×÷"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(pick.randint(0, 60)):
            word = stems[min(int(pick.expovariate(0.1)), len(stems) - 1)]
            for _ in range(pick.choice([0, 0, 0, 1, 1, 2])):
                k = pick.randrange(len(word))
                word = pick.choice([word[:k] + word[k + 1 :], word[:k] + pick.choice("abcÉz") + word[k:], word[:k] + pick.choice("abcé") + word[k + 1 :]])
            words.append(word.upper() if pick.random() < 0.1 else word)
        rows.append((i, pick.choice([" ", ". ", "7", "\n"]).join(words)))
    rows += [(None, "Aaaaaa aaaaab"), (400, None), (401, ""), (7, rows[7][1]), (402, " ".join(["bbbbbb"] * 5 + ["bbbbbc"] * 25 + ["bbbbcc"] * 125 + ["bbbccc"] * 700))]
    return rows


def result(frame):
    return sorted(tuple(row) for row in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("in_filter", [1 << 23, 40])
def test_groups_are_those_of_brute_force(spark, monkeypatch, in_filter):
    monkeypatch.setattr(spelling, "WORDS_PER_FILTER", in_filter)
    rows = corpus()
    docs = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, n int").repartition(4)
    counts = plain_words(rows)
    want = plain(counts)
    assert len(want) > 150 and sum(row[1] is not None for row in want) > 20 and any(row[2] != row[1] for row in want if row[1])
    assert result(spelling.group(spelling.words(docs))) == want


def test_every_edit_passes_the_filter_and_few_others(spark):
    pick = random.Random(1)
    some = sorted({"".join(pick.choices("abcdefghij", k=pick.randint(6, 9))) for _ in range(3000)})
    frame = spark.createDataFrame([(word, 5) for word in some], "word string, n long")
    sizes = Counter(map(len, some))
    filters = spelling.build(frame, sizes, 0, 1)
    codes = {length: spelling.hashes(spelling.letters([w for w in some if len(w) == length])) for length in sizes}
    assert all(len(spelling.passing(filters, length, its, 0, 1)) == len(its) for length, its in codes.items())
    used = spelling.np.frombuffer(b"abcdefghij", dtype="uint8")
    found = list(spelling.neighbours(some, filters, used))
    true = [pair for pair in found if pair[1] in set(some)]
    assert len(set(found)) == len(found) and len(found) - len(true) < 0.002 * len(some) * 80


def test_long_texts_ties_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG_TEXT", 100)
    text = "ab cdefgh " * 5000
    docs = spark.createDataFrame([(1, text + "XYZXYZ xyzxyz xyzxyz xyzxyz xyzxyz")], "doc_id long, text string")
    got = {row.word: row.n for row in spelling.words(docs).collect()}
    assert got == plain_words([(1, text + "XYZXYZ xyzxyz xyzxyz xyzxyz xyzxyz")])
    tied = spark.createDataFrame([("aaaaaa", 5), ("aaaaab", 25), ("aaaaac", 25), ("ëaaaaa", 24)], "word string, n long")
    assert result(spelling.group(tied))[0] == ("aaaaaa", "aaaaab", "aaaaab", 5, 3, 25)
    assert spelling.group(spelling.words(docs.limit(0))).count() == 0
