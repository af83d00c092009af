from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import lines, links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def sample(seed):
    """Short and long texts, copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \n", "One", "one", "one two", "one two three four five", "One two three four FIVE"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 9, 12, 15, 40, 120]))]
        text = " ".join(base)
        out += [text, text, *(edited(rng, base, rng.choice([1, 1, 2, 3])) for _ in range(6)), text + " " + passage, passage + " " + text]
    rng.shuffle(out)
    return out


def expected(texts):
    sets = {}
    for k, t in enumerate(texts):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links_of = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
                if sets[a] != sets[b]:
                    links_of[sets[a]].add(sets[b])
                    links_of[sets[b]].add(sets[a])
    return {k: (len(s), find(k), len(links_of[s])) for k, s in sets.items()}


@pytest.mark.parametrize("boundary", [None, 0, 6, 12])
def test_similar_documents_equal_brute_force(spark, docs, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(links, "choose_boundary", lambda *_: boundary)
    texts = sample(5)
    rows = links.similar_documents(docs(*texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows} == expected(texts)


def test_large_groups_are_split_into_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(links, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(links, "LEAST_FREQUENT", 2)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(80)]
    texts = [edited(rng, base, k % 4) for k in range(60)]
    rows = links.similar_documents(docs(*texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows} == expected(texts)


def test_repeated_ids_null_ids_and_empty_tables(spark, docs):
    text = "a b c d e f g"
    rows = links.similar_documents(docs((3, text), (3, text), (None, text), (None, None))).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == [("3", 3, "3"), ("3", 3, "3"), ("None", 0, "None"), ("None", 3, "3")]
    assert links.similar_documents(docs("x").limit(0)).count() == 0
    kept = links.one_of_each(docs((3, text), (3, text), (4, text + " h"), (5, "other"), (6, None)))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]  # three of four shingles are less than 80 of a hundred


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text) + 1)
        text[at : at + rng.randrange(2)] = rng.choice(["", "a", "é", "日"])
    return "".join(text)


def test_banded_distance_equals_dynamic_programming():
    rng = random.Random(3)
    a = ["".join(rng.choice("abé") for _ in range(rng.randrange(50))) for _ in range(800)]
    b = [changed(rng, x, rng.randrange(6)) for x in a]
    for edits in (0, 1, 2, 4):
        for x, y, d in zip(a, b, lines.edit_distances(a, b, edits), strict=True):
            true = distance(x, y)
            assert d == true if true <= edits else d > edits


def test_near_lines_share_a_key():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abcde") for _ in range(rng.randrange(40, 70)))
        b = changed(rng, a, rng.randrange(3))
        (found,) = lines.Lines.of([a + "\n" + b])
        if len(b) >= 40 and distance(a, b) <= 2:
            assert set(found.keys(np.array([0]))[0].tolist()) & set(found.keys(np.array([1]))[0].tolist())


def wanted_lines(texts):
    places = defaultdict(list)
    for k, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if len(line) >= lines.LEAST_CHARS:
                places[line].append((k, n))
    order = sorted((min(p), line) for line, p in places.items())
    near = {line: next((q for q, other in order[:k] if abs(len(line) - len(other)) <= 2 and distance(line, other) <= 2), None) for k, (_, line) in enumerate(order)}
    return {(*p, *(near[line] or min(ps)), near[line] is not None) for line, ps in places.items() for p in ps if near[line] or p != min(ps)}


@pytest.mark.parametrize("block", [1024, 5])
def test_duplicate_lines_equal_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK_LINES", block)
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(30, 60))) for _ in range(25)]
    pool += [changed(rng, x, rng.randrange(1, 4)) for x in pool] + ["same start of a line that is long enough " + str(k) for k in range(20)]
    texts = [None, "", *("\n".join(rng.choice(pool) for _ in range(4)) for _ in range(40))]
    rows = lines.duplicate_lines(docs(*texts)).collect()
    assert {(r.doc_id, r.line_no, r.like_doc, r.like_line, r.edits_apart) for r in rows} == wanted_lines(texts)
    assert lines.duplicate_lines(docs("x").limit(0)).count() == 0


def test_lines_are_removed_and_the_rest_stays(spark, docs):
    long = "this line is clearly longer than forty characters"
    table = docs(long + "\nshort", "short\n" + long, long, None, "")
    kept = {r.doc_id: r.text for r in lines.without_duplicate_lines(table).collect()}
    assert kept == {0: long + "\nshort", 1: "short", 3: None, 4: ""}
    assert lines.without_duplicate_lines(table).columns == table.columns


def test_rows_that_share_an_id_lose_their_own_lines_alone(spark, docs):
    first, copy = "a first line that stands here once", "a line that another document has as well"
    table = docs((7, f"first\n{first}"), (7, f"zz\n{copy}"), (None, f"one\n{first} and more"), (None, f"two\n{copy}"), (9, copy))
    kept = sorted((str(r.doc_id), r.text) for r in lines.without_duplicate_lines(table, every_line=True).collect())
    assert kept == [("7", f"first\n{first}"), ("7", "zz"), ("None", f"one\n{first} and more"), ("None", f"two\n{copy}")]


def test_rows_that_may_link_by_size_and_place(spark):
    threshold = links.Threshold(80)
    rng = random.Random(8)
    for _ in range(200):
        pool = rng.sample(range(1000), 60)
        sets = [frozenset(rng.sample(pool[:54], rng.randrange(30, 52))) for _ in range(12)]
        rows = sorted((e, len(s), k, c) for c, s in enumerate(sets) for k, e in enumerate(sorted(s)[: threshold.prefix(len(s))]))
        key, n, place, owner = np.array(rows).T
        alive = links.may_link(key, n, place, threshold)
        meet = {(a, b) for x, a, keep_a in zip(key, owner, alive) for y, b, keep_b in zip(key, owner, alive) if x == y and a < b and keep_a and keep_b}
        assert meet >= {(a, b) for a in range(12) for b in range(a + 1, 12) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    many = np.zeros(40, np.int64)
    assert links.may_link(many, np.arange(100, 140), np.full(40, 39), threshold).all()
