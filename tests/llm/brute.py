"""Plain versions of the operators, written from their contracts alone."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where: dict = {}
    for d in sorted(sets):
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    pairs = Counter((a, b) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    for (a, b), shared in pairs.items():
        if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def private(text: str | None) -> tuple:
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    found.sort()
    kinds = ("email", "ip", "card", "phone")
    listed = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)
    return *(sum(k == i for _, k, _ in found) for i in range(4)), sha(listed), listed


def secret(text: str | None) -> tuple:
    text, found = text or "", []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    kinds = ("assign", "access", "hex")
    listed = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)
    return *(sum(k == i for _, k, _ in found) for i in range(3)), sha(listed), listed


def top(vectors: list[tuple[int, list | None]], every: int = 50, k: int = 5) -> list[tuple]:
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in rows:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in rows if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in capped]
        share = (budget - sum(capped.values())) / (sum(weight[s] for s in left) or 1)
        over = [s for s in left if weight[s] * share > 2 * sizes[s]]
        if not over:
            return capped | {s: weight[s] * share for s in left}
        capped |= {s: 2.0 * sizes[s] for s in over}


def repeats(docs: list[tuple[int, str | None]], size: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for d, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            piece = data[i : i + size]
            if piece in seen:
                gone[i : i + size] = b"\1" * size
            else:
                seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def sentence_repeats(docs: list[tuple[int, str | None]], least: int = 3, words: int = 20, long: int = 40) -> dict[int, tuple[str | None, int, int]]:
    """Text without repeated sentences, number of sentences, number removed."""
    split: dict[int, list[list]] = {}
    for d, text in docs:
        text, parts, at = text or "", [], 0
        for i, c in enumerate(text):
            if c == "\n" or (c in " \t\r\x0b\x0c" and i and text[i - 1] in ".!?"):
                parts.append([at, i + 1])
                at = i + 1
        if at < len(text):
            parts.append([at, len(text)])
        sentences: list[list] = []
        for a, b in parts:
            found = WORD.findall(lower(text[a:b]))
            if found:
                sentences.append([a, b, found])
            elif sentences:
                sentences[-1][1] = b
        split[d] = sentences
    places: dict[tuple, list[tuple[int, int, int]]] = {}
    for d, sentences in split.items():
        spans = set()
        n = len(sentences)
        for i in range(n):
            for j in range(i + least - 1, n):
                if sum(len(s[2]) for s in sentences[i : j + 1]) >= words:
                    spans.add((i, j))
                    break
            for j in range(i - least + 1, -1, -1):
                if sum(len(s[2]) for s in sentences[j : i + 1]) >= words:
                    spans.add((j, i))
                    break
            if len(sentences[i][2]) >= long:
                spans.add((i, i))
        for i, j in spans:
            places.setdefault(tuple(w for s in sentences[i : j + 1] for w in s[2]), []).append((d, i, j))
    gone: dict[int, set[int]] = {d: set() for d in split}
    for found in places.values():
        first = min(found)[:2]
        for d, i, j in found:
            if (d, i) != first:
                gone[d].update(range(i, j + 1))
    out = {}
    for d, text in docs:
        kept, at = [], 0
        for k, (a, b, _) in enumerate(split[d]):
            if k in gone[d]:
                kept.append(text[at:a])
                at = b
        out[d] = (None if text is None else "".join(kept) + text[at:], len(split[d]), len(gone[d]))
    return out


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int | None, str | None]], size: int = 10) -> dict[int, tuple]:
    """Words, words in any occurrence of a window, items with one, and a hash of the items."""
    where: dict[tuple, set] = {}
    for i, text in items:
        w = item_words(text)
        for k in range(max(len(w) - size + 1, min(len(w), 1))):
            where.setdefault(tuple(w[k : k + size]), set()).add(i)
    lengths, out = sorted({len(x) for x in where}), {}
    for d, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := where.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out[d] = (len(w), len(hit), len(names), sha(",".join(names)))
    return out


class Aligner:
    """Both tokenizers on whole texts, and their tokens' bytes, from the contract."""

    def __init__(self):
        import public_tokenizers as P
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in visible]
        self.letters = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def tokens(self, text: str | None) -> tuple[list, list]:
        if not text:
            return [], []
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def alignments(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """Rows of the alignment's contract, in the order of ``docs``."""
    both, split, counts = Aligner(), [], Counter()
    for d, text in docs:
        ends = []
        for side in both.tokens(text):
            at, own = 0, []
            for i, x in side:
                at += len(x)
                own.append((at, i))
            ends.append(own)
        a, b = ends
        at_end = dict(b)
        links = [(x, at_end[e]) for e, x in a if e in at_end]
        counts.update(links)
        split.append((d, a, b, links))
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for d, a, b, links in split:
        cuts = sorted({e for e, _ in a} & {e for e, _ in b})
        groups, i, j = [], 0, 0
        for cut in cuts:
            left, right = [], []
            while i < len(a) and a[i][0] <= cut:
                left.append(str(a[i][1]))
                i += 1
            while j < len(b) and b[j][0] <= cut:
                right.append(str(b[j][1]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(";".join(groups)) if groups else ""))
    return out


def collocations(docs: list[tuple[str | None, str | None]], longest: int = 3, least: int = 10, top: int = 2000) -> list[tuple]:
    """Ranked phrases of ``(lang, text)`` rows, from the contract."""
    counts: dict[str, Counter] = {}
    for lang, text in docs:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            own.update(w[i : i + n] for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, own in counts.items():
        total = sum(c for w, c in own.items() if len(w) == 1)
        found = {w: c for w, c in own.items() if len(w) > 1 and c >= least}
        within: dict = {}
        for w, c in found.items():
            for n in range(2, len(w)):
                for i in range(len(w) - n + 1):
                    within[w[i : i + n]] = max(within.get(w[i : i + n], 0), c)
        rows = []
        for w, a in found.items():
            if 100 * within.get(w, 0) >= 50 * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[w[:k]] * own[w[k:]]), k, own[w[:k]], own[w[k:]]) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return out
