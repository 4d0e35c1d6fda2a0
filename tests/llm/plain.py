"""Plain Python versions of the operators, and tables with every awkward case."""

from __future__ import annotations

import base64
import re
from itertools import combinations

import public_tokenizers
import tiktoken

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
EXTRA = ", kept boolean, size string, quality string, mix long, spans string, node string, score string, digest long, _id long, _kept string"


def rows() -> list[tuple]:
    """Null, empty, blank, short, long, repeated and hot rows."""
    import random

    pick = random.Random(5)
    vocabulary = ["".join(pick.choice("abcdeé ßtrno") for _ in range(pick.randint(1, 9))).replace(" ", "") or "a" for _ in range(400)]
    text = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    base = text(120)
    made = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n\x0b ", "en", "b"),
        (4, "One word", None, "b"),
        (5, "A b c", "en", "c"),
        (6, text(6000), "en", "c"),
        (None, text(80), "de", None),
        (None, text(80), "de", None),
        (7, "same line\nsame line\n\nsame line " * 20, "en", "a"),
        (8, "token = 'abcdefgh' AKIA" + "Q" * 16 + " " + "0af9" * 7 + " Password:short PASSWORD: \"longer1\"", "en", "d"),
        (9, "İstanbul ſecret=notakey tokenſ Token:=a Token: bbbbbbb" + text(60), "en", "d"),
        (10, "x" * 3000 + " " + "ab" * 2000, "en", "a"),
        (11, text(60) + " ### $$$ %%% &&& *** <> ||", "fr", "e"),
    ]
    made += [(20 + i, base + f" tail{i}", "en", "hot") for i in range(12)]  # near copies
    made += [(40 + i, base, "en", "hot") for i in range(12)]  # exact copies
    made += [(60, text(90), "en", "a")] * 3  # repeated rows
    made += [(70 + i, text(pick.randint(50, 200)), pick.choice(["en", "fr"]), pick.choice("abcde")) for i in range(40)]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in made]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def low_words(text: str | None) -> list[str]:
    return words((text or "").translate(LOW))


def shingles(text: str | None, size: int) -> frozenset:
    w = low_words(text)
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(table: list[tuple], size: int, percent: int) -> list[int]:
    """For each (id, text) the number of its component, by comparing all pairs."""
    sets = [shingles(t, size) for _, t in table]
    label = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    return label


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    t = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def tokenizer() -> tiktoken.Encoding:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def runs(codes: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by trying all periods at all places."""
    n, found = len(codes), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and codes[j] == codes[j + p]:
                j += 1
            length = j + p - i
            smaller = any(codes[i : i + length - q] == codes[i + q : i + length] for q in range(1, p))
            if j > i and length >= max(least, exponent * p) and not smaller:
                found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def longest_lyndon(codes: list, falling: bool = False) -> list[int]:
    """For each place the distance to the next smaller suffix."""
    c = [-x for x in codes] if falling else list(codes)
    n = len(c)
    return [next((j for j in range(i + 1, n) if c[j:] < c[i:]), n) - i for i in range(n)]


def repeated_words(table: list[tuple]) -> list[set]:
    """For each (id, text) the places of words in a window of 13 that a smaller id has, too; no id is the greatest."""
    rank = lambda i: float("inf") if i is None else i
    least: dict[tuple, float] = {}
    windows = []
    for i, t in table:
        w = words(t)
        windows.append([tuple(w[k : k + 13]) for k in range(len(w) - 12)])
        for s in windows[-1]:
            least[s] = min(rank(i), least.get(s, float("inf")))
    return [
        {k + j for k, s in enumerate(own) if least[s] < rank(i) for j in range(13)} for (i, _), own in zip(table, windows)
    ]


def embeddings() -> list[tuple]:
    """Vectors with every awkward case: null, empty, short, non-finite, repeated, of large and of equal entries."""
    import random

    pick = random.Random(11)
    made = [(i, [pick.gauss(0, 1 + d / 3) for d in range(6)]) for i in range(60)]
    made += [(60, None), (61, []), (62, [1.0]), (63, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (64, [float("nan")] + [0.0] * 5)]
    made += [(65, [float("inf")] + [0.0] * 5), (66, [0.0] * 6), (66, [0.0] * 6), (None, [0.5] * 6), (67, [250.0] + [0.25] * 5)]
    return made


def sketch(text: str | None, size: int = 5, fraction: int = 4) -> list[int]:
    """Sorted distinct hashes of the runs of words in the lowest part of the range; the lowest one where there is none."""
    import xxhash

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    hashed = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words(text)]
    runs = [hashed[i : i + size] for i in range(max(len(hashed) - size + 1, 1 if hashed else 0))]
    found = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed=h)
        found.add(signed(h))
    low = {h for h in found if h < -(2**63) + 2**64 // fraction}
    return sorted(low or ({min(found)} if found else set()))


def printed(hashes: list[int]) -> str:
    return ".".join(f"{h % 2**64:016x}" for h in hashes)


def likeness(a: list[int], b: list[int]) -> float:
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
