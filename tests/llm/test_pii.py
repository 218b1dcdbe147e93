import random
import re
import time

import numpy as np
import pytest

from palimpsest.llm import pii

SCHEMA = "doc_id long, text string, pii string, kind int"
GIVEN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub(r"\D", "", m[0])) <= 15),
]


def given(text):
    return [(k, m.start(), m.end()) for k, (_, regex, ok) in enumerate(GIVEN) for m in regex.finditer(text) if ok(m)]


def odd_texts():
    rnd = random.Random(4)
    bits = ["a.b@c.de", "@", "x@", "@y.z", "a@b.c@d.e", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (583) 555-6359", "+49", "++12345678901", "(", ")", "-", " ", "é", "👍", "word", "007", ".", "%", "\n"]
    return ["".join(rnd.choices(bits, k=rnd.randrange(12))) for _ in range(1500)] + ["", "9" * 5000, "a" * 5000 + "@", "1 " * 3000]


def test_rules_equal_the_given_patterns():
    for t in odd_texts():
        assert pii.rule_spans(t) == given(t), t


def test_windows_cover_stretches():
    rnd = random.Random(0)
    for n in (1, 50, 96, 97, 500):
        text = "".join(rnd.choices("aaaaaaaaaaaaaaaaaaaaa0٣", k=n))
        ids = pii.characters(text)
        for reach in (pii.REACH, None):
            near = np.zeros(n, bool)
            for a, b in pii.stretches(text, reach):
                near[a:b] = True
                cover = np.zeros(n, bool)
                for s, w in pii.windows(ids, a, b):
                    cover[s : s + 96] = True
                    assert (w[: min(96, b - s)] == ids[s : min(s + 96, b)]).all()
                assert cover[a:b].all()
            for i in np.flatnonzero(ids == 48):
                assert near[max(0, i - pii.REACH) : i + pii.REACH + 1].all()
            assert reach is not None or near.all()


def test_characters_are_read_by_what_they_stand_for():
    assert bytes(pii.characters("a1٣４ＡＢ＠é👍߉")).decode() == "a134AB@\x7f\x7f9"
    assert [pii.stretches(t) != [] for t in ("nothing here", "joe at work dot org", "x＠y", "٣", "[at]", " AT ")] == [False, True, True, True, True, True]


def test_gradients_equal_differences():
    tagger = pii.Tagger(size=3, hidden=4, seed=1)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rnd = np.random.default_rng(2)
    ids, tags = rnd.integers(0, 128, (3, 6)), rnd.integers(0, pii.TAGS, (3, 6))
    _, g = tagger.gradients(ids, tags)
    for k, a in tagger.p.items():
        for at in rnd.choice(a.size, min(6, a.size), replace=False):
            if k == "emb" and at // a.shape[1] not in ids:
                continue
            old = a.flat[at]
            a.flat[at] = old + 1e-3
            up = tagger.gradients(ids, tags)[0]
            a.flat[at] = old - 1e-3
            down = tagger.gradients(ids, tags)[0]
            a.flat[at] = old
            assert abs((up - down) / 2e-3 - g[k].flat[at]) < 2e-2 * max(0.05, abs(g[k].flat[at])), k


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger().fit(*pii.made_windows(pii.MADE_WINDOWS))


def test_held_out_windows_are_tagged(tagger):
    ids, tags = pii.made_windows(150, seed=99)
    right = wanted = found = 0
    for em, t in zip(tagger.emissions(ids), tags, strict=True):
        got = {s[:3] for s in tagger.decode(em) if s[2] < 96}
        heads = [i for i in range(96) if t[i] % 2]
        gold = set()
        for i in heads:
            j = i + 1
            while j < 96 and t[j] == t[i] + 1:
                j += 1
            if j < 96:
                gold.add(((t[i] - 1) // 2, i, j))
        right, wanted, found = right + len(got & gold), wanted + len(gold), found + len(got)
    assert right >= 0.85 * wanted and right >= 0.85 * found


def test_rules_stay_and_the_tagger_adds(spark, tagger):
    rows = [(i, t, "clash", 1) for i, t in enumerate(odd_texts()[:200])]
    rows += [(900, None, "", 0), (None, "a.b@c.de", "", 0), (901, "please call (583) 555-6359 at noon or write to me", "", 0), (902, "word " * 30000 + "a.b@c.de", "", 0), (3, rows[3][1], "", 0)]
    out = pii.find_pii(spark.createDataFrame(rows, SCHEMA), tagger).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [(s.kind, s.start, s.end) for s in r.pii if s.rule] == given(r.text or "")
        for s in r.pii:
            assert s.rule or not any(o.rule and o.start < s.end and s.start < o.end for o in r.pii)
    (added,) = [r.pii for r in out if r.doc_id == 901]
    assert [(s.kind, s.start, s.end) for s in added] == [(3, 12, 26)]


def test_what_reading_near_signs_alone_loses(tagger):
    """Against reading every text whole: personal data written with signs or spelled out, among prose of which most is never read."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéü", k=rnd.randrange(2, 9)))
    planted = ["(583) 555-6359", "５８３-５５５-６３５９", "583-555-6359", "jane at mailhost dot org", "٣١٢-٤٥٦-٧٨٩٠", "a.b@c.de", "4111 1111 1111 1111"]
    texts, there = [], {}
    for i in range(120):
        words = [word() for _ in range(rnd.randrange(30, 200))]
        at = rnd.randrange(len(words))
        words[at] = planted[i % len(planted)]
        start = len(" ".join(words[:at])) + (at > 0)
        texts.append(" ".join(words))
        there[i] = (start, start + len(words[at]))
    strong = lambda reach: {(i, k, a, b) for i, spans in enumerate(tagger.spans(texts, reach)) for k, a, b, m in spans if b - a >= pii.LEAST_CHARS and m >= pii.LEAST_MARGIN}
    right = lambda found: {s for s in found if s[2] < there[s[0]][1] and s[3] > there[s[0]][0]}
    near, whole = strong(pii.REACH), strong(None)
    read = sum(b - a for t in texts for a, b in pii.stretches(t)) / sum(map(len, texts))
    print(f"planted found near signs {len(right(near))}, in whole texts {len(right(whole))}, in both {len(right(near) & right(whole))}; false {len(near) - len(right(near))} and {len(whole) - len(right(whole))}; read {read:.2f} of all characters")
    assert len(right(whole)) >= 110 and {s[0] for s in right(whole)} <= {s[0] for s in right(near)}
    assert len(near) - len(right(near)) <= len(whole) - len(right(whole))


def test_whole_texts_are_read_unless_a_reach_is_given(spark):
    class All(pii.Tagger):
        def spans(self, texts, reach=None):
            return [[(0, a, b, 99.0) for a, b in pii.stretches(t, reach)] for t in texts]

    text = "no sign of anything " * 20
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    read = lambda **k: [(x.start, x.end) for x in pii.find_pii(docs, All(), **k).first().pii]
    assert read() == [(0, len(text))] and read(reach=pii.REACH) == []


def plainly(tagger, text, reach):
    """spans() of one text window by window and step by step."""
    ids, out = pii.characters(text), []
    weight = np.minimum(np.arange(1, 97), np.arange(96, 0, -1))[:, None]
    for a, b in pii.stretches(text, reach):
        total, seen = np.zeros((b - a, pii.TAGS)), np.zeros((b - a, 1))
        for s, w in pii.windows(ids, a, b):
            n = min(96, b - s)
            total[s - a : s - a + n] += (tagger.emissions(w[None])[0] * weight)[:n]
            seen[s - a : s - a + n] += weight[:n]
        out += [(k, a + x, a + y, m) for k, x, y, m in tagger.decode(total / seen)]
    return out


@pytest.mark.parametrize("lot", [1, 7, pii.LOT])
def test_reading_side_by_side_finds_what_reading_plainly_does(tagger, monkeypatch, lot):
    monkeypatch.setattr(pii, "LOT", lot)
    monkeypatch.setattr(pii, "GROUP", 5)
    rnd = random.Random(7)
    texts = odd_texts()[:150] + ["", "7", "1" * 47, "1" * 48, "2 " * 24 + "3", "4" * 96, "5" * 97, "٣" * 145, "plain words " * 30]
    texts += ["".join(rnd.choices(["(583) 555-6359", "joe at work dot org", "a.b@c.de", "word", " ", ", ", "12", "the"], k=rnd.randrange(1, 60))) for _ in range(40)]
    for reach in (None, pii.REACH):
        for text, found in zip(texts, tagger.spans(texts, reach), strict=True):
            plain = plainly(tagger, text, reach)
            assert [s[:3] for s in found] == [s[:3] for s in plain], text
            assert np.allclose([s[3] for s in found], [s[3] for s in plain], atol=0.02)


def test_whole_texts_are_read_much_faster_than_plainly(tagger):
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choices("etaoinshr", k=rnd.randrange(2, 9))) for _ in range(400)) for _ in range(60)]
    began = time.process_time()
    tagger.spans(texts, None)
    fast = time.process_time() - began
    cut = [w for t in texts for _, w in pii.windows(pii.characters(t), 0, len(t))]
    began = time.process_time()
    tagger.emissions(np.stack(cut))
    assert fast < 0.6 * (time.process_time() - began)
