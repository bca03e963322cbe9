"""Plain versions of the operators, one row at a time, to test against."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def secrets(text):
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = {
        "assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    kinds = list(found)
    rows = sorted((a, kinds.index(k), b) for k, each in found.items() for a, b in each)
    return [len(found[k]) for k in kinds] + [sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in rows))]


def luhn(digits):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(digits[::-1])) % 10 == 0


def personal(text):
    text, n = text or "", lambda m: len(re.findall(r"[0-9]", m[0]))
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= n(m) <= 19 and luhn(re.sub(r"[^0-9]", "", m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= n(m) <= 15],
    }
    return [len(x) for x in found.values()] + [sha(",".join(f"{k}:{a}:{b}" for k, each in found.items() for a, b in each))]


def simhash(text):
    text = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def simhash_components(rows):
    fp = {i: simhash(t) for i, t in rows}
    ids = sorted(fp)
    x = np.array([fp[i] for i in ids], np.uint64)
    pairs = []
    for k, i in enumerate(ids):
        pairs += [(i, ids[k + 1 + j]) for j in np.flatnonzero(np.bitwise_count(x[k + 1 :] ^ x[k]) <= 2)]
    return {i: (f"{fp[i]:016x}", c) for i, c in components(ids, pairs).items()}


def substring_dedup(rows, window=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    least = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), sha(kept), kept)
    return out


def ids_crc32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def vector_links(rows, least=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = [(i, v / np.abs(v).max()) for i, v in ok]
    pairs = []
    for k, (i, v) in enumerate(ok):
        for j, w in ok[k + 1 :]:
            if len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= least:
                pairs.append((i, j))
    n = Counter(x for p in pairs for x in p)
    return {i: (n[i], c, i == c) for i, c in components([i for i, _ in rows], pairs).items()}


def top_scores(rows, k=5, every=50):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def shingle_set(text, size=5):
    w = WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()


def near_pairs(texts, least=0.8):
    """Pairs of places of texts that are near copies."""
    sets = [shingle_set(t) for t in texts]
    return [(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x == y or len(x & y) >= least * len(x | y)]


def _gram_hash(gram):
    mask, h = (1 << 64) - 1, len(gram)
    for c in gram:
        x = ord(c) * 0x9E3779B97F4A7C15 & mask
        h = (h * 0xD6E8FEB86659FD93 + (x ^ x >> 32)) & mask
    return h ^ h >> 29


def _grams(text):
    plain = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    return [plain[k : k + n] for n in (3, 4) for k in range(len(plain) - n + 1) if plain[k + 1 : k + n - 1].isalpha()]


class Languages:
    """A bit for each slot and language, learned from (lang, text)."""

    def __init__(self, rows, top=20_000, bits=19):
        counts = {}
        for lang, text in rows:
            counts.setdefault(lang, Counter()).update(_grams(text))
        share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
        self.names, self.bits, self.on = sorted(counts), bits, {}
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        for lang, c in counts.items():
            own = [g for g in c if share[lang][g] >= 0.1 * max(s.get(g, 0) for s in share.values())]
            own.sort(key=lambda g: (-c[g], signed(_gram_hash(g))))
            self.on[lang] = {s for g in own[:top] for s in self.slots(g)}

    def slots(self, gram):
        h, mask = _gram_hash(gram), (1 << self.bits) - 1
        return h & mask, (h >> 64 - self.bits) ^ (h >> 20 & mask)

    def predict(self, text):
        grams = [self.slots(g) for g in _grams(text)]
        if not grams or not self.names:
            return "und", 0.0
        best = ("und", -9.0)
        for lang in self.names:
            on = self.on[lang]
            false = (len(on) / (1 << self.bits)) ** 2
            score = (sum(a in on and b in on for a, b in grams) / len(grams) - false) / (1 - false)
            if score > best[1]:
                best = (lang, score)
        return best[0], min(1.0, max(0.0, best[1]))


def best_path(model):
    """A function that gives a word's ids by the best path over pieces: sums in single precision, ties to the longer last piece."""
    n = model.get_piece_size()
    plain = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    score = {p: np.float32(model.get_score(i)) for p, i in plain.items()}
    unknown, longest = np.float32(min(score.values()) - np.float32(10)), max(map(len, plain))
    byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}

    def ids(word):
        best = [(np.float32(0), 0)]
        for end in range(1, len(word) + 1):
            top = None
            for start in range(max(0, end - longest), end):
                piece = word[start:end]
                if piece in score or end - start == 1:
                    x = best[start][0] + score.get(piece, unknown)
                    if top is None or x > top[0]:
                        top = (x, start)
            best.append(top)
        out, end = [], len(word)
        while end:
            start = best[end][1]
            piece = word[start:end]
            out = ([plain[piece]] if piece in plain else [byte[b] for b in piece.encode()]) + out
            end = start
        return out

    return ids


CUE = r"(?<![^\W_])(?:{})(?![^\W_])(?:[\s:#.=]|(?i:number|nummer|numero|número|num|no|nr|is)\b){{0,8}}"


def announced(text):
    """Identifiers that a cue word announces, by kind: sets of spans."""
    cues = {"iban": "iban", "account": "account|acct|konto|kontonummer|compte|cuenta", "card": "card|visa|mastercard|amex", "phone": "phone|telephone|tel|mobile|fax|telefon|teléfono", "ssn": "ssn"}
    number = {"account": r"[0-9](?:[ -]?[0-9])*", "card": r"[0-9](?:[ -]?[0-9])*", "phone": r"\(?[0-9][0-9 ().-]*[0-9]", "ssn": r"[0-9]{3}([ -]?)[0-9]{2}\1[0-9]{4}(?![0-9])"}
    bounds = {"account": (6, 17), "card": (13, 15), "phone": (7, 15), "ssn": (9, 9)}
    out = {k: set() for k in cues}
    for kind, words in cues.items():
        forms = "|".join(x for w in sorted(words.split("|"), key=len, reverse=True) for x in (w, w.capitalize(), w.upper()))
        for m in re.finditer(CUE.format(forms), text):
            if kind == "iban":
                for stop in range(min(len(text), m.end() + 64), m.end() + 14, -1):
                    x = re.sub("[ -]", "", text[m.end() : stop])
                    if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}", text[m.end() : stop]) and not text[stop : stop + 1].isalnum() and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1:
                        out[kind].add((m.end(), stop))
                        break
            elif found := re.compile(number[kind]).match(text, m.end()):
                n = len(re.findall("[0-9]", found[0]))
                if bounds[kind][0] <= n <= bounds[kind][1] and (kind != "card" or luhn(re.sub("[^0-9]", "", found[0]))):
                    out[kind].add(found.span())
    return out
