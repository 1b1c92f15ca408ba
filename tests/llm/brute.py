"""Plain-Python versions of the text operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, n: int) -> frozenset:
    words = [bytes(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(rows: list[tuple[int, str | None]], n: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """key -> (set size, least key of its component), by comparing all pairs."""
    sets = {key: shingles(text, n) for key, text in rows}
    least = {key: key for key in sets}

    def root(key: int) -> int:
        while least[key] != key:
            key = least[key]
        return key

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {key: (len(sets[key]), root(key)) for key in sets}


def fingerprint(text: str | None) -> int:
    """SimHash of 3-word shingles, repeats included."""
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    made = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in made]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """key -> (fingerprint, least key of its component), by comparing all pairs."""
    marks = {key: fingerprint(text) for key, text in rows}
    least = {key: key for key in marks}

    def root(key: int) -> int:
        while least[key] != key:
            key = least[key]
        return key

    keys = sorted(marks)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {key: (f"{marks[key]:016x}", root(key)) for key in marks}


def edits(word: str, alphabet: str) -> set[str]:
    """All strings one inserted, deleted or replaced character away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def spelling_words(rows: list[tuple[int, str | None]]) -> Counter:
    import zlib

    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return Counter({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def spelling(counts: Counter) -> dict[str, tuple]:
    """word -> (form, root, n, n_near, form_n)."""
    alphabet = "".join(sorted(set("".join(counts))))
    near = {w: [v for v in edits(w, alphabet) if v in counts] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: v if v is not None and counts[v] >= 2 * counts[w] else None for w, v in best.items()}

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def aligned(rows: list[tuple[int, str | None]], first: str, second: str) -> list[tuple]:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), whole texts by the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a_model, b_model = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
    a_model.encode_special_tokens = True
    alphabet = sorted(ByteLevel.alphabet())
    plain = [chr(c) for c in range(256) if chr(c) in alphabet]
    extra = iter(sorted(c for c in alphabet if ord(c) > 255))
    byte = {chr(c): c for c in range(256) if chr(c) in plain}
    for c in range(256):
        if chr(c) not in plain:
            byte[next(extra)] = c
    done = []
    for key, text in rows:
        raw = f" {text}".encode()
        a = a_model.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            p = b_model.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode())
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            done.append((key, [], [], []))
            continue
        a_ends = [sum(map(len, a_bytes[: i + 1])) for i in range(len(a))]
        b_ends = [sum(map(len, b_bytes[: i + 1])) for i in range(len(b))]
        both = sorted(set(a_ends) & set(b_ends))
        groups = [
            ([x for x, e in zip(a, a_ends) if low < e <= high], [y for y, e in zip(b, b_ends) if low < e <= high])
            for low, high in zip([0, *both], both)
        ]
        done.append((key, a, b, groups))
    count = Counter()
    for _, _, _, groups in done:
        count.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    most: dict[int, int] = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for key, a, b, groups in done:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        best = sum(count[x] == most[x[0]] for x in links)
        out.append((key, len(a), len(b), len(groups), len(links), best, sum(count[x] for x in links), text))
    return out
