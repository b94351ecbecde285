"""Plain single-process versions of the corpus operators, to hold results against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_components(docs: list[tuple[int, str | None]], width: int, percent: int = 80) -> dict[int, int]:
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {i for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)


def half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def quality_kept(docs: list[tuple[int, str | None, str | None, str | None]]) -> set[int]:
    """Ids that the base rules and a dense minimum-covariance-determinant estimate keep; docs: id, text, lang, source."""
    from tapeworks.llm import quality_rules as Q

    floors = np.array(list(Q.FLOORS.values()))
    rows, keep = {}, set()
    for i, text, lang, source in docs:
        n, chars, symbols, dup, repeat = base_statistics(text)
        if n < 20 or 100 * repeat > 30 * n:
            continue
        t = text or ""
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        v = np.array([np.log(chars / n), np.log1p(10 * symbols / n), dup / max(lines, 1), repeat / n, sum("A" <= c <= "Z" for c in t) / chars])
        rows[i] = (half_up(v * 1000) / 1000, lang, source)
    sizes, langs = Counter((lang, s) for _, lang, s in rows.values()), Counter(lang for _, lang, _ in rows.values())
    key = lambda lang, s: (lang, s) if sizes[lang, s] >= Q.MIN_GROUP else (lang,) if langs[lang] >= Q.MIN_GROUP else () if len(rows) >= Q.MIN_GROUP else None
    members = {k: [r[0] for r in rows.values() if k == () or (r[1],) == k or (r[1], r[2]) == k] for k in {key(lang, s) for _, lang, s in rows.values()} - {None}}
    best = {}
    for k, v in members.items():
        x = np.stack(v)
        med = np.quantile(x, 0.5, axis=0)
        z = np.abs(x - med) / np.maximum(1.4826 * np.quantile(np.abs(x - med), 0.5, axis=0), floors)
        found = []
        for d in (np.sqrt((z * z).sum(1)), z.max(1)):
            d, last = half_up(np.log1p(d) * 1000), np.inf
            while True:
                inner = x[d <= np.quantile(d, Q.H) + 1e-9]
                mean, cov = inner.mean(0), np.cov(inner.T, bias=True) + np.diag(floors**2)
                d = half_up(np.log1p(np.sqrt(np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean))) * 1000)
                now = np.linalg.slogdet(cov)[1] / 2
                if last - now <= Q.CONVERGED:
                    break
                last = now
            found.append((np.linalg.slogdet(cov)[1], mean, cov, np.expm1(np.quantile(d, 0.5) / 1000) / np.sqrt(Q.CHI2_MEDIAN)))
        best[k] = min(found, key=lambda f: f[0])
    for i, (v, lang, s) in rows.items():
        k = key(lang, s)
        if k is None:
            keep.add(i)
            continue
        _, mean, cov, scale = best[k]
        d = np.sqrt((v - mean) @ np.linalg.inv(cov) @ (v - mean))
        if d <= Q.CUT * max(scale, 0.5):
            keep.add(i)
    return keep


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    return sum(int(x) if i % 2 == 0 else (int(x) * 2 - 9 if int(x) > 4 else int(x) * 2) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def redact(text: str, spans: list[tuple[str, int, int]], order: tuple[str, ...]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], order.index(x[0]))):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def parts(text: str) -> list[tuple[str, str, int]]:
    """(part, what follows it, number of its sentence) of Latin text, gap by gap."""
    import unicodedata

    out, start, sentence = [], 0, 0
    for gap in re.finditer(r"[ \t\u00a0\u3000]*\n\s*|[ \t\u00a0\u3000]+", text):
        before, after = text[gap.start() - 1 : gap.start()], text[gap.end() : gap.end() + 1]
        end = "\n" in gap[0] or before in (".", "!", "?", "\u2026")
        paste = bool(before and after) and (unicodedata.category(before) == "Ll" or before == "|") and unicodedata.category(after) == "Lu"
        if (end and before) or "\n" in gap[0] or paste:
            out.append((text[start : gap.start()], gap[0], sentence))
            start, sentence = gap.end(), sentence + end
    return [*out, (text[start:], "", sentence)]


def span_removals(docs: list[tuple[int, str | None]], sentences: int = 2, least: int = 20) -> dict[int, tuple[str, int]]:
    """What is left of each text and how many sentences lose words; docs: id (all different), text."""
    cut = {i: [(p, gap, s, lower(p).split()) for p, gap, s in parts(t)] for i, t in docs if t}
    where = defaultdict(set)
    for i, found in cut.items():
        at = [k for k, x in enumerate(found) if x[3]]
        enough = lambda run: len({found[k][2] for k in run}) >= sentences and sum(len(found[k][3]) for k in run) >= least  # noqa: B023, E731
        spans = set()
        for a in range(len(at)):
            spans |= {(a, b) for b in range(a, len(at)) if enough(at[a : b + 1]) and not (b > a and enough(at[a:b]))}
            spans |= {(b, a) for b in range(a + 1) if enough(at[b : a + 1]) and not (b < a and enough(at[b + 1 : a + 1]))}
        for a, b in spans:
            where[tuple(" ".join(found[k][3]) for k in at[a : b + 1])].add((i, at[a], at[b]))
    gone = defaultdict(set)
    for places in where.values():
        for i, a, b in sorted(places)[1:]:
            gone[i] |= {k for k in range(a, b + 1) if cut[i][k][0].strip()}
    return {i: ("".join(p + g for k, (p, g, *_) in enumerate(cut[i]) if k not in gone[i]) if i in cut else t, len({cut[i][k][2] for k in gone[i]})) for i, t in docs}


def readings(fixer, stretch: str) -> tuple[str, float]:
    """The best reading of a stretch by trying all of them."""
    import itertools

    from tapeworks.llm.toxicity import char_classes

    classes, chars, best = char_classes(), stretch.lower(), ("", np.inf)
    for pick in itertools.product(*(fixer._options(chars, i) for i in range(len(chars)))):
        read = "".join(x for x, _ in pick)
        ks = [0, 0, *(int(classes[min(ord(c), 0xFFFF)]) for c in read)]
        cost = sum(c for _, c in pick) + sum(fixer.costs[a][b][c] for a, b, c in zip(ks, ks[1:], ks[2:], strict=False))
        if cost < best[1] - 1e-9:
            best = (read, cost)
    return best


def least_packing(lengths: list[int], capacities: tuple[int, ...], overhead: int) -> int:
    """The least cost of all ways to put pieces into bins, by subsets."""
    n = len(lengths)
    price = [min((c + overhead for c in capacities if c >= sum(lengths[i] for i in range(n) if s >> i & 1)), default=None) for s in range(1 << n)]
    best = [0] + [10**9] * ((1 << n) - 1)
    for s in range(1, 1 << n):
        low, sub = s & -s, s
        while sub:
            if sub & low and price[sub] is not None:
                best[s] = min(best[s], best[s ^ sub] + price[sub])
            sub = (sub - 1) & s
    return best[-1]
