import random
import re

from palimpsest.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, contamination string, _x int"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, size):
    wins = []
    for name, text in items:
        w = WORD.findall(low(text))
        n = min(size, len(w))
        wins += [(None if name is None else str(name), w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for doc_id, text, *_ in docs:
        words, hit, names = list(WORD.finditer(low(text))), set(), set()
        plain = [m.group() for m in words]
        for name, w in wins:
            for i in range(len(plain) - len(w) + 1):
                if plain[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    if name is not None:
                        names.add(name)
        spans = []
        for i in sorted(hit):
            if spans and i - 1 in hit:
                spans[-1] = (spans[-1][0], words[i].end())
            else:
                spans.append((words[i].start(), words[i].end()))
        out.append((doc_id, len(plain), len(hit), sorted(names), spans))
    return sorted(out, key=str)


def data():
    rnd = random.Random(5)
    words = ["Der", "die", "das", "héllo", "WORLD", "x1", "ßtraße", "q", "中文", "lorem", "ipsum", "z9"]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([2, 4, 5, 9])))) for i in range(12)] + [(3, "das die das die"), (None, "x1 q x1 q"), (50, None), (51, " .,; "), (52, "q")]
    docs = [(i, rnd.choice([" ", ", ", "\n", "--"]).join(rnd.choices(words, k=rnd.choice([1, 8, 60])))) for i in range(40)]
    docs += [(40 + i, f"{docs[i][1]}. {items[i][1].upper()}! {docs[i + 1][1]}") for i in range(12)]
    docs += [(90, None), (91, ""), (92, "..."), (None, items[1][1]), (5, docs[5][1]), (93, "lorem " * 50000)]
    return [(*d, "clash", 1) for d in docs], items


def rows_of(found):
    return sorted(((r.doc_id, r.contamination.n_words, r.contamination.n_hit, r.contamination.items, [(s.start, s.end) for s in r.contamination.spans]) for r in found.collect()), key=str)


def test_equal_to_brute_force_in_one_shard_and_many(spark):
    docs, items = data()
    for size in (4, 13):
        want = brute(docs, items, size)
        for most in (10**6, 60):
            found = dc.find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), window=size, shard_chars=most)
            assert rows_of(found) == want
            assert found.columns == ["doc_id", "text", "_x", "contamination"]


def test_blocks_stand_in_every_window():
    for window in range(1, 16):
        for n in range(1, 60):
            words = [b"%d" % i for i in range(n)]
            blocks = [(a, a + len(b)) for a, b in dc.blocks_of(words, window)]
            size = min(window, n)
            assert all(any(s <= a and b <= s + size for a, b in blocks) for s in range(n - size + 1))
            assert sum(b - a for a, b in blocks) <= n + window


def test_empty_tables_and_filter(spark):
    docs, items = data()
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS)
    assert dc.without_contaminated(frame, none).count() == len(docs)
    assert dc.find_contamination(frame.limit(0), some).count() == 0
    clean = [d for d, r in zip(sorted(docs, key=lambda d: str(d[0])), brute(docs, items, 13), strict=False)]
    assert clean
    want = sorted(str(r[0]) for r in brute(docs, items, 13) if not (r[2] and 20 * r[2] >= r[1]))
    got = dc.without_contaminated(frame, some)
    assert got.columns == frame.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == want
