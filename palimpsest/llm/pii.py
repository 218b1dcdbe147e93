"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions.

The rules find e-mail addresses, IPv4 addresses, card and phone numbers; the tagger, trained in numpy
on labelled spans, adds what is written otherwise: a phone number without its plus, an address spelled
out with "at" and "dot", digits of other scripts. Characters are read by what they stand for: decimal
digits of any script as 0-9, full-width forms as ASCII. A text is cut into overlapping windows; their
emission scores are averaged, those near a window's middle weighing most, and one Viterbi pass over all
of a stretch decides, so a span that crosses windows is decided once.

A whole text is one stretch if `reach` is None. That takes several times as long as reading only
what lies within `reach` characters of a sign: a decimal digit, an @, or the words "at" and "dot" as an
address is spelled out with; nothing else in a text can be a span of any kind. Whole texts are the default; tests/llm/test_pii.py
measures what `reach=REACH` loses against reading everything (no planted span, and a few false ones).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import slices, text_of, texts_of, with_column

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE, REACH = 96, 48, 28
#: Windows that one matrix product takes, groups of them that go through the LSTMs side by side, and about how many have their scores held at once.
GROUP, GROUPS, LOT = 320, 3, 3840
#: Bounds of the training sample: documents and windows drawn from the corpus, windows made up.
SAMPLE_DOCS, SAMPLE_WINDOWS, MADE_WINDOWS = 3000, 500, 1500
#: What a span of the tagger must have (parameters of find_pii): characters, and the score by which it beats "no span".
LEAST_CHARS, LEAST_MARGIN = 7, 8.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# A match of these starts where a run of digits starts.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
#: What any span of the tagger holds: a digit of any script, an @, or how one is spelled out.
_TRACE = re.compile(r"[\d@\uff20]|[\x20(\[](?:at|dot)[\x20)\]]", re.IGNORECASE)


def _stand_ins() -> np.ndarray:
    """What a character up to U+FFFF is read as: ASCII as itself, digits and full-width forms as ASCII, any other as 127."""
    table = np.full(0x10000, 127, np.uint8)
    table[:127] = np.arange(127)
    for c in range(0x80, 0x10000):
        if (value := unicodedata.decimal(chr(c), None)) is not None:
            table[c] = 48 + value
    table[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
    return table


STAND_INS = _stand_ins()


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest local part before each @, not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    if not _SIGN.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def characters(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return STAND_INS[np.minimum(points, 0xFFFF)]


def stretches(text: str, reach: int | None = REACH) -> list[tuple[int, int]]:
    """Where the tagger reads: all of the text, or what lies within `reach` characters of a sign."""
    if reach is None:
        return [(0, len(text))] if text else []
    out: list[tuple[int, int]] = []
    for m in _TRACE.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows(ids: np.ndarray, a: int, b: int) -> list[tuple[int, np.ndarray]]:
    """(start, WINDOW characters, filled up by 0) that cover a..b with an overlap of WINDOW - STRIDE."""
    out = []
    for s in range(a, max(a + 1, b - (WINDOW - STRIDE)), STRIDE):
        piece = np.zeros(WINDOW, np.uint8)
        piece[: min(WINDOW, b - s)] = ids[s : min(s + WINDOW, b)]
        out.append((s, piece))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions, in numpy."""

    def __init__(self, size: int = 12, hidden: int = 20, seed: int = 0) -> None:
        rnd = np.random.default_rng(seed)
        self.hidden = hidden
        make = lambda *shape: (rnd.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"emb": make(128, size) * 4, "out": make(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": make(size, 4 * hidden), f"u{d}": make(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        ahead = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        out, state, cell, kept = np.empty((n, steps, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = ahead[:, t] + state @ self.p[f"u{d}"]
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            new = f * cell + i * g
            tanh = np.tanh(new)
            kept.append((t, state, cell, i, f, o, g, tanh))
            state, cell = o * tanh, new
            out[:, t] = state
        return out, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(windows, characters, tags)."""
        x = self.p["emb"][ids]
        return np.concatenate((self._run(x, "f")[0], self._run(x, "b")[0]), axis=2) @ self.p["out"] + self.p["bias"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences, and its gradients."""
        n, steps = ids.shape
        x = self.p["emb"][ids]
        runs = {d: self._run(x, d) for d in "fb"}
        both = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        em, moves = both @ self.p["out"] + self.p["bias"], self.p["moves"]
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for t in range(1, steps):
            alpha[:, t] = em[:, t] + _logsum(alpha[:, t - 1][:, :, None] + moves, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _logsum(moves + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        whole = _logsum(alpha[:, -1], 1)
        one = np.eye(TAGS, dtype=np.float32)[tags]
        gold = (em * one).sum((1, 2)) + moves[tags[:, :-1], tags[:, 1:]].sum(1)
        d_em = (np.exp(alpha + beta - whole[:, None, None]) - one) / n
        pair = np.exp(alpha[:, :-1, :, None] + moves + (em + beta)[:, 1:, None, :] - whole[:, None, None, None]).sum((0, 1))
        counts = np.zeros((TAGS, TAGS))
        np.add.at(counts, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        g = {"moves": (pair - counts) / n, "out": np.einsum("nth,ntk->hk", both, d_em), "bias": d_em.sum((0, 1))}
        d_both, d_x, h = d_em @ self.p["out"].T, np.zeros_like(x), self.hidden
        for d, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            w, u = self.p[f"w{d}"], self.p[f"u{d}"]
            d_ahead, d_state, d_cell, d_u = np.empty((n, steps, 4 * h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros_like(u)
            for t, state, cell, i, f, o, gg, tanh in reversed(runs[d][1]):
                ds = part[:, t] + d_state
                dc = d_cell + ds * o * (1 - tanh**2)
                z = np.concatenate((dc * gg * i * (1 - i), dc * cell * f * (1 - f), ds * tanh * o * (1 - o), dc * i * (1 - gg**2)), axis=1)
                d_ahead[:, t], d_state, d_cell = z, z @ u.T, dc * f
                d_u += state.T @ z
            g |= {f"w{d}": np.einsum("ntd,ntk->dk", x, d_ahead), f"u{d}": d_u, f"c{d}": d_ahead.sum((0, 1))}
            d_x += d_ahead @ w.T
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], ids, d_x)
        return float((whole - gold).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 7, batch: int = 32, rate: float = 0.02, seed: int = 0) -> Tagger:
        """Adam over shuffled batches, the rate falling to a tenth."""
        rnd, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        total = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order = rnd.permutation(len(ids))
            for lo in range(0, len(ids), batch):
                rows = order[lo : lo + batch]
                _, g = self.gradients(ids[rows], tags[rows])
                size = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, a in g.items():
                    a = a * min(1.0, 5.0 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a**2
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, em: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(kind, start, end, margin over no span) of the best tag path; a span starts at its B tag or where a kind starts."""
        moves, score, back = self.p["moves"], em[0], []
        for e in em[1:]:
            each = score[:, None] + moves
            back.append(each.argmax(0))
            score = each.max(0) + e
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        out, t = [], 0
        while t < len(path):
            if path[t] == 0:
                t += 1
                continue
            kind, s = (path[t] - 1) // 2, t
            t += 1
            while t < len(path) and path[t] == 2 + 2 * kind:
                t += 1
            own = em[s:t][np.arange(t - s), path[s:t]].sum() - em[s:t, 0].sum()
            own += sum(moves[a, b] - moves[0, 0] for a, b in zip(path[s : t - 1], path[s + 1 : t], strict=True))
            out.append((kind, s, t, float(own)))
        return out

    def _fused(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both directions' weights for leads(): gates halved, since sigmoid(z) is (1 + tanh(z / 2)) / 2, states kept doubled."""
        h, cells, heads = self.hidden, [], []
        for k, d in enumerate("fb"):
            cells.append((np.concatenate((self.p[f"u{d}"] / 2, self.p[f"w{d}"], self.p[f"c{d}"][None])) * np.repeat([0.5, 1], [3 * h, h])).T)
            own = self.p["out"][k * h : (k + 1) * h]
            heads.append((own[:, 1:] - own[:, :1]).T / 2)
        seen = np.concatenate((self.p["emb"], np.ones((len(self.p["emb"]), 1))), axis=1)
        return tuple(np.ascontiguousarray(x, np.float32) for x in (np.stack(cells), np.stack(heads), seen))

    def leads(self, ids: np.ndarray) -> np.ndarray:
        """(characters, tags but the first, windows) for ids (characters, windows): by how much emissions() has each tag before "no span".

        Both directions go in one step and all gates in one tanh; windows lie side by side, in groups that suit the matrix product,
        as many as the cache holds.
        """
        (steps, n), h = ids.shape, self.hidden
        cells, heads, seen = self._fused()
        filled = np.zeros((steps, n + GROUPS), np.uint8)
        filled[:, :n] = ids
        out = np.empty((steps, TAGS - 1, n + GROUPS), np.float32)
        for lo in range(0, n, GROUPS * GROUP):
            m = min(GROUPS * GROUP, n - lo)
            groups = -(-m // GROUP)
            wide = -(-m // groups)
            x = np.ascontiguousarray(seen[filled[:, lo : lo + groups * wide].reshape(steps, groups, wide)].transpose(0, 1, 3, 2))
            into, z = np.zeros((groups, 2, cells.shape[2], wide), np.float32), np.empty((groups, 2, 4 * h, wide), np.float32)
            cell, ends = np.zeros((groups, 2, h, wide), np.float32), np.empty((2, steps, groups, TAGS - 1, wide), np.float32)
            state, gates, i, f, o, g = into[:, :, :h], z[:, :, : 3 * h], z[:, :, :h], z[:, :, h : 2 * h], z[:, :, 2 * h : 3 * h], z[:, :, 3 * h :]
            for t in range(steps):
                into[:, 0, h:], into[:, 1, h:] = x[t], x[steps - 1 - t]
                np.matmul(cells, into, out=z)
                np.tanh(z, out=z)
                np.add(gates, 1, out=gates)
                np.multiply(cell, f, out=cell)
                np.multiply(g, i, out=g)
                np.add(cell, g, out=cell)
                np.multiply(cell, 0.5, out=cell)
                np.tanh(cell, out=g)
                np.multiply(g, o, out=state)
                np.matmul(heads[0], state[:, 0], out=ends[0, t])
                np.matmul(heads[1], state[:, 1], out=ends[1, steps - 1 - t])
            part = out[:, :, lo : lo + groups * wide].reshape(steps, TAGS - 1, groups, wide)
            np.add(*ends.transpose(0, 1, 3, 2, 4), out=part)
            part += (self.p["bias"][1:] - self.p["bias"][0])[:, None, None]
        return out[:, :, :n]

    def _may_be_spans(self, leads: np.ndarray, first: np.ndarray, last: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Which characters may lie in a span of the best path: for all others a bound says that "no span" wins whatever the rest is.

        A span's characters n, its moves n + 1 (fewer at a stretch's ends): no run of them, however chosen, may gain more than the largest lead of each
        and the largest move. A move into a kind's inner tag from its first is larger; `shift` takes that from it and gives it to the move before.
        """
        moves = (self.p["moves"] - self.p["moves"][0, 0]).astype(np.float64)
        shift = np.zeros(TAGS)
        shift[1::2] = max(0.0, moves[1::2, 2::2].max() - moves[2::2, 2::2].max())
        moves = moves + shift - shift[:, None]
        most, enter, leave = moves[1:, 1:].max(), moves[0, 1:].max(), moves[1:, 0].max()
        gain = leads.max(axis=0).astype(np.float64) + most
        gain[first] += max(0.0, shift[1:].max() - enter)
        gain[last] += max(0.0, (-shift[1:]).max() - leave)
        gain[~inside] = -1e4
        def runs(g: np.ndarray) -> np.ndarray:
            total = np.cumsum(g)
            return total - np.minimum.accumulate(np.concatenate(([0.0], total[:-1])))
        best = runs(gain) + runs(gain[::-1])[::-1] - gain
        return (best + enter - most + leave >= -1e-2) & inside

    def _paths(self, leads: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, tags: np.ndarray) -> None:
        """Viterbi over leads[:, start:end] for many pieces at once, the longest first; "no span" is on both sides but at a stretch's ends. Fills tags."""
        moves = self.p["moves"] - self.p["moves"][0, 0]
        order = np.argsort(starts - ends, kind="stable")
        starts, ends, first, last = starts[order], ends[order], first[order], last[order]
        sizes = ends - starts
        held: list[np.ndarray] = []
        for t in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t, side="left"))
            own = np.concatenate((np.zeros((1, n), np.float32), leads[:, starts[:n] + t]))
            if t == 0:
                score = own + np.where(first, np.float32(0), moves[0][:, None])
            else:
                before = held[-1]
                score = before[0, :n] + moves[0][:, None]
                for a in range(1, TAGS):
                    np.maximum(score, before[a, :n] + moves[a][:, None], out=score)
                score += own
            held.append(score)
        now = np.zeros(len(sizes), np.int64)
        for t in range(int(sizes[0]) - 1, -1, -1):
            n = held[t].shape[1]
            more = held[t + 1].shape[1] if t + 1 < len(held) else 0
            now[:more] = (held[t][:, :more] + moves[:, now[:more]]).argmax(0)
            now[more:n] = (held[t][:, more:] + np.where(last[more:n], np.float32(0), moves[:, :1])).argmax(0)
            tags[starts[:n] + t] = now[:n]

    def _read(self, pieces: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """(kind, start, end, margin) in each stretch of characters: windows' leads averaged, and the best path through all of a stretch."""
        sizes = np.array([len(p) for p in pieces])
        blocks = np.maximum(1, -(-(sizes - STRIDE) // STRIDE)) + 1
        ends = np.cumsum(blocks)
        firsts = ends - blocks
        flat = np.zeros(int(ends[-1]) * STRIDE, np.uint8)
        for p, at in zip(pieces, (firsts * STRIDE).tolist(), strict=True):
            flat[at : at + len(p)] = p
        rows = flat.reshape(-1, STRIDE).T
        begins = np.delete(np.arange(rows.shape[1]), ends - 1)
        each = self.leads(np.concatenate((rows[:, begins], rows[:, begins + 1])))
        rising, falling = np.arange(1, STRIDE + 1, dtype=np.float32)[:, None, None], np.arange(STRIDE, 0, -1, dtype=np.float32)[:, None, None]
        early, late = each[:STRIDE], each[STRIDE:]
        early *= rising / (STRIDE + 1)
        late *= falling / (STRIDE + 1)
        mean = np.empty((STRIDE, TAGS - 1, rows.shape[1]), np.float32)
        at = 0
        for a, b in zip(firsts.tolist(), (ends - 1).tolist(), strict=True):
            mean[:, :, a:b] = early[:, :, at : at + b - a]
            mean[:, :, b] = 0
            mean[:, :, a + 1 : b + 1] += late[:, :, at : at + b - a]
            at += b - a
        mean[:, :, firsts] *= (STRIDE + 1) / rising
        mean[:, :, ends - 1] *= (STRIDE + 1) / falling
        leads = np.ascontiguousarray(mean.transpose(1, 2, 0)).reshape(TAGS - 1, -1)
        start = firsts * STRIDE
        inside = np.zeros(len(flat) + 1, np.int8)
        np.add.at(inside, start, 1)
        np.add.at(inside, start + sizes, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        may = self._may_be_spans(leads, start, start + sizes - 1, inside)
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in pieces]
        turns = np.flatnonzero(np.diff(may, prepend=False, append=False))
        # Two stretches may touch; no piece crosses from one to the next.
        owner = lambda x: np.searchsorted(start, x, side="right") - 1
        if not len(turns):
            return out
        bounds = np.union1d(turns, start[may[start]])
        a = bounds[:-1][may[bounds[:-1]]]
        b = bounds[np.searchsorted(bounds, a, side="right")]
        tags = np.zeros(len(flat), np.int64)
        self._paths(leads, a, b, a == start[owner(a)], b == (start + sizes)[owner(a)], tags)
        for x, y, k, margin in zip(*self._marked(leads, tags, start), strict=True):
            i = int(owner(x))
            out[i].append((k, x - int(start[i]), y - int(start[i]), margin))
        return out

    def _marked(self, leads: np.ndarray, tags: np.ndarray, start: np.ndarray) -> tuple[list, list, list, list]:
        """Starts, ends, kinds and margins of the spans that tags mark; a span starts at its B tag or where a kind or a stretch starts."""
        held = np.flatnonzero(tags)
        if not len(held):
            return [], [], [], []
        own, kind = tags[held], (tags[held] - 1) // 2
        new = (own % 2 == 1) | np.isin(held, start)
        new[0] = True
        new[1:] |= (held[1:] != held[:-1] + 1) | (kind[1:] != kind[:-1])
        heads = np.flatnonzero(new)
        moves = self.p["moves"] - self.p["moves"][0, 0]
        gain = leads[own - 1, held].astype(np.float64)
        gain[1:] += np.where(new[1:], 0, moves[own[:-1], own[1:]])
        tails = np.append(heads[1:], len(held)) - 1
        return held[heads].tolist(), (held[tails] + 1).tolist(), kind[heads].tolist(), np.add.reduceat(gain, heads).tolist()

    def spans(self, texts: list[str], reach: int | None = REACH) -> list[list[tuple[int, int, int, float]]]:
        """What the tagger finds in each text: (kind, start, end, margin)."""
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        todo: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def read() -> None:
            for (i, a, _), found in zip(todo, self._read([p for *_, p in todo]), strict=True):
                out[i] += [(k, a + x, a + y, m) for k, x, y, m in found]

        for i, t in enumerate(texts):
            where = stretches(t, reach)
            ids = characters(t) if where else None
            for a, b in where:
                todo.append((i, a, ids[a:b]))
                size += 2 + (b - a) // STRIDE
                if size >= LOT:
                    read()
                    todo, size = [], 0
        if todo:
            read()
        return out


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.uint8)
    for kind, a, b in sorted(spans, key=lambda s: s[1] - s[2]):
        if not tags[a:b].any():
            tags[a], tags[a + 1 : b] = 1 + 2 * kind, 2 + 2 * kind
    return tags


def made_windows(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows of invented words with invented personal data, in more forms than the rules know, and look-alikes without a label."""
    rnd = np.random.default_rng(seed)
    pick = lambda x: x[int(rnd.integers(len(x)))]
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    word = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyzéèüñ") for _ in range(int(rnd.integers(2, 9))))
    plain = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rnd.integers(3, 9))))

    def card() -> str:
        body = pick("45") + digits(14)
        full = body + next(d for d in "0123456789" if luhn(body + d))
        return pick(["", " ", "-"]).join(full[k : k + 4] for k in range(0, 16, 4))

    made = [
        (0, lambda: f"{plain()}{pick(['', '.', '_'])}{digits(int(rnd.integers(0, 3)))}@{plain()}{pick(['', digits(1) + '.example'])}.{pick(['com', 'org', 'net', 'de'])}"),
        (1, lambda: ".".join(str(int(rnd.integers(1, 255))) for _ in range(4))),
        (2, card),
        (3, lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"),
        (3, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        (3, lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        (3, lambda: f"+{digits(2)} {digits(3)} {digits(7)}"),
        (0, lambda: f"{plain()}{pick([' at ', ' (at) ', ' [at] '])}{plain()}{pick([' dot ', ' (dot) ', ' [dot] '])}{pick(['com', 'org', 'net', 'de'])}"),
        (3, lambda: "".join(chr(0xFF10 + int(c)) if c.isdigit() else c for c in f"{digits(3)}-{digits(3)}-{digits(4)}")),
    ]
    other = [lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)},{digits(3)}.{digits(2)}", lambda: "".join(pick("0123456789abcdef") for _ in range(int(rnd.integers(20, 41)))), lambda: "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: digits(int(rnd.integers(1, 9))), lambda: f"password={digits(4)}{plain()}{digits(3)}", lambda: f"{word()} @ {word()}", lambda: f"{plain()} at {plain()} {plain()}", lambda: f"the dot {plain()}"]
    ids, tags = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.uint8)
    for row in range(n):
        parts, spans, at = [], [], 0
        while at < WINDOW:
            if parts and rnd.random() < 0.22:
                if rnd.random() < 0.6:
                    kind, make = pick(made)
                    part = make()
                    spans.append((kind, at, at + len(part)))
                else:
                    part = pick(other)()
            else:
                part = word()
            parts += [part, pick([" ", " ", " ", ", ", ". "])]
            at += len(part) + len(parts[-1])
        text = "".join(parts)
        ids[row] = characters(text)[:WINDOW]
        tags[row] = tags_of(len(text), spans)[:WINDOW]
    return ids, tags


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, made: int = MADE_WINDOWS, epochs: int = 7) -> Tagger:
    """A tagger trained on made-up windows and, labelled by the rules, windows of a bounded sample of the corpus.

    Null and empty texts teach nothing; repeated rows are drawn by their text, so together; of an empty table
    the made-up windows alone teach.
    """
    text = text_of(text_col)
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).where(F.rlike("text", F.lit("[0-9@]")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, "text"):
                out = []
                for t in texts_of(part, "text").to_pylist():
                    ids, tags = characters(t), tags_of(len(t), rule_spans(t))
                    for a, b in stretches(t):
                        for s, w in windows(ids, a, b):
                            own = np.zeros(WINDOW, np.uint8)
                            own[: min(WINDOW, b - s)] = tags[s : min(s + WINDOW, b)]
                            out.append((w.tobytes(), own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["ids", "tags"])

    drawn = sample.mapInArrow(run, "ids binary, tags binary").orderBy(F.xxhash64("ids"), "ids", "tags").limit(sample_windows).collect()
    ids, tags = made_windows(made)
    for name in ("ids", "tags"):
        more = np.frombuffer(b"".join(bytes(r[name]) for r in drawn), np.uint8).reshape(-1, WINDOW)
        ids, tags = (np.concatenate((ids, more)), tags) if name == "ids" else (ids, np.concatenate((tags, more)))
    return Tagger().fit(ids, tags, epochs)


def find_pii(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", out: str = "pii", reach: int | None = None, least_chars: int = LEAST_CHARS, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """`docs` with a column `out`: ARRAY<STRUCT<kind INT, start, end, rule BOOLEAN>> of code point spans, by kind, then start.

    All of the rules' spans are there; the tagger adds spans that overlap none of them, of at least
    `least_chars` characters and `least_margin`, from what it reads (see `reach` above). A null text is empty;
    rows may repeat; other columns are kept, one named `out` is replaced; an empty table gives no rows.
    Without a tagger only the rules speak.
    """
    rows = docs.drop(out)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, text_col):
                texts = texts_of(part, text_col).to_pylist()
                found = [[(k, a, b, True) for k, a, b in rule_spans(t)] for t in texts]
                for own, more in zip(found, tagger.spans(texts, reach) if tagger else [[]] * len(texts), strict=True):
                    taken = sorted((a, b) for _, a, b, _ in own)
                    starts = np.array([a for a, _ in taken])
                    far = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
                    for k, a, b, margin in more:
                        at = int(np.searchsorted(starts, b)) if taken else 0
                        if b - a >= least_chars and margin >= least_margin and (at == 0 or far[at - 1] <= a):
                            own.append((k, a, b, False))
                cells = [[{"kind": k, "start": a, "end": b, "rule": r} for k, a, b, r in sorted(own)] for own in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, kind)], [*part.schema.names, out])

    span = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("rule", T.BooleanType())])
    return with_column(rows, run, out, T.ArrayType(span))
