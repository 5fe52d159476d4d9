import re
from collections import Counter

from rowlake.llm import quality
from rowlake.llm.common import Scratch

from tests.llm.brute import frame


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(8)}
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def normal(line):
    return tuple(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in re.findall(r"[^\x20\x09-\x0D]+", line))


def brute(rows, min_docs, share, loss, most=1000):
    """rows: (doc_id, text, host) -> (doc_id, n_words, ..., base_failed, removed, kept), and the kept texts."""
    texts = {(h or "", t or "") for _, t, h in rows}
    of = Counter(h for h, _ in texts)
    seen = Counter((h, l) for h, t in texts for l in {normal(x) for x in t.split("\n")} if l)
    out = []
    for k, t, h in rows:
        b = base(t)
        bad = [x for x in (t or "").split("\n") if (c := seen[h or "", normal(x)]) > min_docs and c > min(most, share * of[h or ""])]
        gone = sum(len(normal(x)) for x in bad)
        out.append((k, *b, gone, not b[5] and gone <= loss * b[0]))
    return out


MENU = "Home | About | Contact us 12"
ROWS = [
    *((i, f"{MENU if i % 3 else MENU.upper().replace('12', '99')}\n" + " ".join(f"w{i}x{j}" for j in range(30 if i % 2 else 12)), "a" if i % 4 else "b") for i in range(40)),
    *((100 + i, "same text in every copy " * 6, "a") for i in range(20)), (200, None, None), (201, "", "a"), (202, " \n \n", "a"), (None, "x\ny\nx\n\nx", "b"), (204, "É#ü $\n" * 9, None),
    (205, "one two three four five six seven eight nine " * 4 + "end", "a"), (206, "a b " * 40000, "a"), (207, "\nfirst empty\n\n", "b"), (209, MENU + "\n" + " ".join(f"k{i}" for i in range(40)), "b"), (208, MENU + "\n" + MENU + "\nlast", "a"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(k, t, h, len(t or ""), 1, 2, "z") for k, t, h in rows], "doc_id long, text string, source string, n_chars long, `__host` int, line int, `a.b` string")


def test_verdicts(spark):
    feats = quality.features(table(spark), Scratch(spark, "t"))
    got = quality.verdicts(feats, 4, 0.05, 0.4).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept").collect()
    want = brute(ROWS, 4, 0.05, 0.4)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {x[-1] for x in want} == {True, False} and any(x[-2] and x[-1] for x in want)


def test_filter_removes_lines(spark, monkeypatch):
    want = {x[0] for x in brute(ROWS, 4, 0.05, 0.4) if x[-1]}
    results = []
    for bound in (quality.MAX_BROADCAST, 0):
        monkeypatch.setattr(quality, "MAX_BROADCAST", bound)
        df = quality.filter_documents(table(spark), Scratch(spark, "t"), min_docs=4, max_share=0.05, max_loss=0.4)
        assert df.columns == table(spark).columns
        results.append(sorted(map(tuple, df.collect())))
        assert {x[0] for x in results[-1]} == want
        for k, text, _, n, *_ in results[-1]:
            before = next(t for i, t, _ in ROWS if i == k)
            frequent = [x for x in before.split("\n") if normal(x) == normal(MENU)]
            assert n == len(text) and text == "\n".join(x for x in before.split("\n") if x not in frequent)
    assert results[0] == results[1]


def test_empty(spark):
    assert quality.verdicts(quality.features(table(spark, []), Scratch(spark, "t"))).count() == 0
    assert quality.filter_documents(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_production_limits(spark):
    """A line of a fifth of a small host goes, one of few documents of a middling host stays, one above the ceiling goes on a large host."""
    letters = lambda n: "".join("abcdefghij"[int(x)] for x in str(n))  # noqa: E731  (digits are all alike in a line)
    say = lambda i: " ".join(f"p{letters(i)}q{letters(j)}" for j in range(30))
    rows = [(i, ("Subscribe to our letter\n" if i < 11 else "") + say(i), "small") for i in range(50)]
    rows += [(1000 + i, ("Read it again\n" if i < 11 else "") + say(1000 + i), "middling") for i in range(500)]
    rows += [(2000 + i, ("All rights reserved\n" if i < 60 else "") + say(2000 + i), "large") for i in range(1500)]
    feats = quality.features(table(spark, rows), Scratch(spark, "t"))
    lines = {(r.host, r.n_docs) for r in quality.frequent_lines(feats).collect()}
    assert lines == {("small", 11)} and quality.MAX_DOCS == 1000
    assert {(r.host, r.n_docs) for r in quality.frequent_lines(feats, max_docs=50).collect()} == {("small", 11), ("large", 60)}
    got = {r.doc_id: r.n_removed_words for r in quality.verdicts(feats).collect()}
    assert got == {x[0]: x[-2] for x in brute(rows, quality.MIN_DOCS, quality.MAX_SHARE, quality.MAX_LOSS)}
