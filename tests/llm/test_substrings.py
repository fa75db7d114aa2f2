"""Substring deduplication against a brute-force model on random texts, and odd texts."""

import random

import pytest

from coffer.llm import substrings


def brute(docs, min_words, min_run):
    """{doc_id: [(start, end)]}: every unit compared with every earlier one, in order of (doc_id, start)."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        cut, marks = substrings.units_of(text or ""), []
        for start, end, n, digest in cut:
            marks.append(digest in seen)
            seen.add(digest)
        spans, i = [], 0
        while i < len(cut):
            j = i
            while j < len(cut) and marks[j]:
                j += 1
            run = list(range(i, j))
            if len(run) < len(cut):
                while run and cut[run[0]][2] < min_words:
                    run.pop(0)
                while run and cut[run[-1]][2] < min_words:
                    run.pop()
            if run and (len(run) == len(cut) or sum(cut[k][2] for k in run) >= min_run):
                spans.append((cut[run[0]][0], cut[run[-1]][1]))
            i = max(j, i + 1)
        if spans:
            out[doc_id] = spans
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choices("ab cd ef gh ij kl mn".split(), k=rnd.randint(1, 7))) + rnd.choice([".", "!", "?"]) for _ in range(14)]
    docs = [(i, "".join(rnd.choice(pool) + rnd.choice([" ", "\n", "  \n"]) for _ in range(rnd.randint(0, 9)))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in substrings.removed_spans(df, 3, 8).collect()}
    assert got == brute(docs, 3, 8)
    # what is outside the spans stays, but for white space beside a cut
    clean = {r.doc_id: r.text for r in substrings.dedup(df, 3, 8).collect()}
    for i, text in docs:
        kept, at = "", 0
        for start, end in got.get(i, []):
            kept, at = kept + text[at:start], end
        assert "".join(clean[i].split()) == "".join((kept + text[at:]).split())
        assert i in got or clean[i] == text


def test_unique_lines_between_equal_head_and_foot_stay(spark):
    head, foot = " ".join(f"head{i}" for i in range(30)) + ".", " ".join(f"foot{i}" for i in range(30)) + "."
    docs = spark.createDataFrame([(1, f"{head}\nred one\n{foot}"), (2, f"{head}\nblue  two\n{foot}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substrings.dedup(docs).collect()} == {1: f"{head}\nred one\n{foot}", 2: "blue  two\n"}


def test_short_copies_unspaced_text_repeated_rows_and_long_texts(spark):
    zh = "".join(chr(0x4e00 + 7 * i) for i in range(60)) + "。"
    long = " ".join(f"w{i}" for i in range(200_000)) + "."
    rows = [(1, "a copy of twelve words or so is found here as well."), (2, "A copy of twelve words, or so, is found here as well."), (3, zh), (4, f"x {zh}\n{zh}"),
            (5, "no, this is only here."), (5, "no, this is only here."), (6, long), (7, "new line\n" + long), (8, None), (None, "last of all these words here."), (9, "  \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in substrings.removed_spans(docs).collect()}
    assert got == {2: [(0, len(rows[1][1]))], 4: [(len(zh) + 3, 2 * len(zh) + 3)], 7: [(9, 9 + len(long))]}
    clean = [(r.doc_id, r.text) for r in substrings.dedup(docs).collect()]
    assert len(clean) == len(rows) and clean.count((5, rows[4][1])) == 2 and (7, "new line\n") in clean and (9, "  \n ") in clean
