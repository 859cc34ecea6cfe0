"""Keys within an edit budget: tiles of like length, bit signatures of letter groups, bounded edit distance.

One edit changes at most q of a key's q-letter groups.  A signature keeps the
parity of the groups (each with its number among equal ones) hashed to a bit, so
keys d edits apart differ in at most 2 * q * d bits; pairs that differ in more are
dropped without looking at the keys.  Signatures are compared word by word, for
blocks of pairs that fit a CPU's cache, until too many bits differ; the edit
distances of the pairs left are taken for thousands of pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: (letters of a group, bits for each letter of a key) of the signatures, each for the pairs that the one before leaves.
FIRST, COARSE, FINE = (1, 1), (2, 4), (4, 16)
#: Long keys of one language share most groups of four letters, so beyond so many letters these are told apart by groups of five.
_LONG, _LONGER = 512, ((4, 8), (5, 32))
#: Pairs of a block, rows of it, words between two looks at it, and the share of its pairs that is worth counting all of them.
_CELLS, _ROWS, _WORDS, _DENSE = 1 << 16, (8, 64), 8, 1 / 4
#: The first pairs of two groups show which signatures are worth their time.
_TRIAL = 1 << 12
#: An edit distance costs as much as so many words of signatures.
_EDIT_WORDS = 2000
#: Keys alike in letters lie together: so many groups of at least so many keys.
_ALIKE = (8, 512)
#: At most so many pairs, and letters of them, wait for their edit distances; fewer for each word of a column are taken one by one.
_WAITING, _WAITING_LETTERS, _FEW = 1 << 12, 1 << 22, 24
#: Letters whose signatures are taken at a time, and most room for the places of letters.
_LETTERS, _TABLE_BYTES = 1 << 15, 1 << 26
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def budget(longest, percent: int):
    """Most edits that two keys may differ by when the longer one has this length."""
    return longest * (100 - percent) // 100


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def _letters(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters one after the other, and the keys' lengths."""
    return np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.array([len(k) for k in keys], dtype=np.int64)


def signatures(keys: Sequence[str], q: int, width: int) -> np.ndarray:
    """A row of ``width`` bits, a power of two from 64 on, in 64-bit words for each key."""
    out = np.zeros((len(keys), width // 64), dtype=np.uint64)
    step = max(1, _LETTERS * len(keys) // max(1, sum(map(len, keys))))
    for at in range(0, len(keys), step):
        codes, size = _letters(keys[at : at + step])
        row = np.repeat(np.arange(len(size), dtype=np.uint64) << np.uint64(40), size)
        n = max(0, len(codes) - q + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(q):
            h += codes[k : k + n]
            h += np.uint64(1)
            h *= _ODD
        whole = row[:n] == row[q - 1 : q - 1 + n]
        groups = np.sort(row[:n][whole] | _mixed(h[whole]) >> np.uint64(24))
        place = np.arange(len(groups))
        first = np.concatenate((np.ones(min(1, len(groups)), dtype=bool), groups[1:] != groups[:-1]))
        nth = place - np.maximum.accumulate(place * first)
        bit = _mixed(_mixed(groups & np.uint64((1 << 40) - 1)) + nth.astype(np.uint64) * _ODD) & np.uint64(width - 1)
        word = (groups >> np.uint64(40)).astype(np.int64) * (width // 64) + (bit >> np.uint64(6)).astype(np.int64)
        np.bitwise_xor.at(out[at : at + step].reshape(-1), word, np.uint64(1) << (bit & np.uint64(63)))
    return out


def _folded(columns: np.ndarray, words: int) -> np.ndarray:
    """Signatures of half the bits, and so on, are the halves' exclusive-or; a column for each key."""
    while len(columns) > words:
        half = len(columns) // 2
        columns = columns[:half] ^ columns[half:]
    return columns


def _alike(keys: Sequence[str]) -> np.ndarray:
    """A number for each key, often the same for keys with like shares of letters; it only puts keys into an order."""
    groups, least = _ALIKE
    if len(keys) < least:
        return np.zeros(len(keys), dtype=np.int64)
    shares = np.zeros((len(keys), 64), dtype=np.float32)
    for at in range(0, len(keys), 4096):
        codes, n = _letters(keys[at : at + 4096])
        flat = np.repeat(np.arange(len(n), dtype=np.int64) * 64, n) + (_mixed(codes * _ODD) & np.uint64(63)).astype(np.int64)
        shares[at : at + 4096] = np.bincount(flat, minlength=len(n) * 64).reshape(-1, 64) / n[:, None]
    nearest = lambda rows: ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
    some = shares[:: max(1, len(keys) // 1024)]
    centres = some[np.linspace(0, len(some) - 1, groups).astype(int)]
    for _ in range(5):
        of = nearest(some)
        centres = np.stack([some[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(groups)])
    return nearest(shares)


def letters_of(key: str) -> dict[str, int]:
    """For each letter the bits of its places."""
    places: dict[str, list[int]] = {}
    for i, ch in enumerate(key):
        places.setdefault(ch, []).append(i)
    size = len(key) // 8 + 1
    out = {}
    for ch, at in places.items():
        bits = bytearray(size)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        out[ch] = int.from_bytes(bits, "little")
    return out


def _within(letters: dict[str, int], m: int, text: str, most: int) -> int:
    """The edit distance of ``text`` to the key of ``m`` > 0 letters, -1 beyond ``most``; columns are bit vectors.

    Distances do not fall along a diagonal, so the one that ends in the last cell may stop it.
    """
    mask, ahead = (1 << m) - 1, m - len(text)
    up, down = mask, 0
    for j, ch in enumerate(text, 1):
        eq = letters.get(ch, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (mask & ~(h | up)), up & h
        rise, fall = (rise << 1 | 1) & mask, (fall << 1) & mask
        up, down = fall | (mask & ~(x | rise)), rise & x
        if not j & 15 and j + ahead > 0:
            cells = (1 << (j + ahead)) - 1
            if j + (up & cells).bit_count() - (down & cells).bit_count() > most:
                return -1
    found = len(text) + up.bit_count() - down.bit_count()
    return found if found <= most else -1


def _same_head(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def edit_distance(a: str, b: str, most: int, letters: dict[str, int] | None = None) -> int:
    """The edit distance, -1 beyond ``most``; ``letters`` may hold those of ``a``."""
    if abs(len(a) - len(b)) > most:
        return -1
    head = _same_head(a, b)
    x, y = a[head:], b[head:]
    tail = _same_head(x[::-1], y[::-1])
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not x or not y:
        return max(len(x), len(y))
    if letters is not None and 2 * len(x) > len(a):
        return _within(letters, len(a), b, most)
    return _within(letters_of(x), len(x), y, most)


class Tile:
    """Keys in groups of like length and letters, by length in each, with signatures whose width follows the length."""

    def __init__(self, keys: Sequence[str]):
        keys = sorted(keys, key=len)
        n = np.array([len(k) for k in keys], dtype=np.int32)
        log = np.ceil(np.log2(np.maximum(n, 16) * COARSE[1])).astype(int)
        self.keys: list[str] = []
        self.groups = []  # (first row, rows behind the last, by letters of a group signatures, a column for each key)
        for c in np.unique(log):
            some = keys[np.searchsorted(log, c) : np.searchsorted(log, c, "right")]
            letters = (1 << c) // COARSE[1]
            kinds = (FIRST, COARSE, *(_LONGER if letters > _LONG else (FINE,)))
            of = _alike(some)
            for g in np.unique(of):
                own = [some[i] for i in np.flatnonzero(of == g).tolist()]
                bits = {q: np.ascontiguousarray(signatures(own, q, max(64, letters * each)).T) for q, each in kinds}
                self.groups.append((len(self.keys), len(self.keys) + len(own), bits))
                self.keys += own
        self.n = np.array([len(k) for k in self.keys], dtype=np.int32)
        self._letters = None

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys' letters, one key's after the other's, and where each key begins."""
        if self._letters is None:
            codes, n = _letters(self.keys)
            if codes.max(initial=0) < 1 << 16:
                codes = codes.astype(np.uint16)
            self._letters = codes, np.cumsum(n) - n
        return self._letters


def _distances(a: Tile, b: Tile, u: np.ndarray, v: np.ndarray, most: np.ndarray, words: int, columns: int | None = None) -> np.ndarray:
    """The edit distance of the keys u of a and v of b for each pair, -1 beyond its ``most``, which is less than 64 * ``words``.

    With ``columns`` only so many letters of the keys v are looked at; 0 if these leave it open.

    Columns are bit vectors as in ``_within``, one operation taking a word of all
    pairs.  A column holds only the ``most`` + 1 diagonals that a distance in the
    budget can use, as what lies off by s letters costs s edits before and after.
    What comes in from beyond them counts as one edit more, so no distance is too
    small.  Distances do not fall along a diagonal; those of the last cell's are counted.
    """
    out = np.full(len(u), -1, dtype=np.int32)
    (a_letters, a_start), (b_letters, b_start) = a.letters(), b.letters()
    rows, ui = np.unique(u, return_inverse=True)
    a_n = a.n[rows].astype(np.int64)
    place = np.arange(a_n.sum()) - np.repeat(np.cumsum(a_n) - a_n, a_n)
    own = a_letters[np.repeat(a_start[rows], a_n) + place]
    code = np.zeros(int(max(a_letters.max(), b_letters.max())) + 1, dtype=np.int64)
    code[own] = 1
    kinds = int(code.sum()) + 1  # 0 is any letter that no key of a has
    code[code == 1] = np.arange(1, kinds)
    ends = b.n[v].astype(np.int64)
    gap = a_n[ui] - ends
    low = -((most - gap) // 2)  # rows above the column's number
    pad = -(-int(-low.min()) // 64) * 64
    size, layer = (int(a_n.max()) + pad) // 64 + words + 1, len(rows) * kinds
    if len(rows) > 1 and 8 * size * layer > _TABLE_BYTES:
        left = ui < len(rows) // 2
        for part in (left, ~left):
            out[part] = _distances(a, b, u[part], v[part], most[part], words, columns)
        return out

    # for each word of places, key of a and letter the bits of its places, so that a column's lie together
    table = np.zeros(size * layer, dtype=np.uint64)
    place += pad
    np.add.at(table, (place >> 6) * layer + np.repeat(np.arange(len(rows)) * kinds, a_n) + code[own], np.uint64(1) << (place & 63).astype(np.uint64))
    who = np.argsort(-ends, kind="stable")  # pairs end from the last to the first
    ends, most, gap, low, n = ends[who], most[who], gap[who], low[who], len(who)
    base, text, at, last = (ui * kinds)[who], b_start[v[who]], low + pad, (gap - low).astype(np.uint64)
    last_word, last_bit = (last >> np.uint64(6)).astype(np.int64), last & np.uint64(63)
    score, one, word = np.maximum(gap, 0), np.uint64(1), np.uint64(64)
    up = [~np.uint64(0) << np.clip(-low - 64 * w, 0, 64).astype(np.uint64) for w in range(words)]
    down = [np.zeros(n, dtype=np.uint64) for _ in range(words)]
    for j in range(min(int(ends[0]), columns or int(ends[0]))):
        if ends[n - 1] <= j:
            k = int(np.searchsorted(-ends, -j, "left"))
            out[who[k:]] = np.where(score[k:] <= most[k:], score[k:], -1)
            if not k:
                return out
            n = k
            who, text, most, ends, base, at, last_word, last_bit, score = (x[:n] for x in (who, text, most, ends, base, at, last_word, last_bit, score))
            up, down = [x[:n] for x in up], [x[:n] for x in down]
        cell = code.take(b_letters.take(text))
        cell += base
        cell += (at >> 6) * layer
        right = (at & 63).astype(np.uint64)
        left, here, carry, same, rise, fall = word - right, table.take(cell), None, [], [], []
        for w in range(words):
            cell += layer
            after = table.take(cell)
            eq = (here >> right) | (after << left)
            here = after
            x = eq & up[w]
            x += up[w]
            if words > 1:
                over = x < up[w]
                if carry is not None:
                    x += carry
                    over |= x < carry
                carry = over.astype(np.uint64)
            x ^= up[w]
            x |= eq
            x |= down[w]
            same.append(x)
            rise.append(down[w] | ~(x | up[w]))
            fall.append(x & up[w])
        for w in range(words):
            x = same[w] >> one
            if w + 1 < words:
                x |= same[w + 1] << np.uint64(63)
            down[w] = rise[w] & x
            up[w] = fall[w] | ~(rise[w] | x)
        ended = same[0] if words == 1 else np.stack(same)[last_word, np.arange(n)]
        score = score + ((ended >> last_bit) & one ^ one).astype(np.int64)
        at = at + 1
        text = text + 1
        if j & 7 == 7:
            kept = np.flatnonzero(score <= most)
            if len(kept) < n * 3 // 4:
                n = len(kept)
                if not n:
                    return out
                who, text, most, ends, base, at, last_word, last_bit, score = (x[kept] for x in (who, text, most, ends, base, at, last_word, last_bit, score))
                up, down = [x[kept] for x in up], [x[kept] for x in down]
    out[who] = np.where(score <= most, np.where(ends <= j + 1, score, 0), -1)
    return out


class _Sieve:
    """What two groups compare, one after the other, and which of it is worth its time for their keys."""

    def __init__(self, a_bits: dict[int, np.ndarray], b_bits: dict[int, np.ndarray]):
        self.steps = []  # (q, columns of a, columns of b) of the same width
        both = [q for q in a_bits if q in b_bits]
        for q in both:
            words = min(len(a_bits[q]), len(b_bits[q]))
            parts = 1 if q == FIRST[0] else 4 if q == FINE[0] == both[-1] else 2
            self.steps += [(q, _folded(a_bits[q], w), _folded(b_bits[q], w)) for w in sorted({max(1, words // p) for p in (1, 2, parts) if p <= parts})]
        self.seen = [[0, 0] for _ in self.steps]  # pairs that came and those left
        self.used = list(range(len(self.steps)))

    def tell(self, k: int, came: int, left: int) -> None:
        """A step that saves less than it costs is left out from then on."""
        self.seen[k][0] += came
        self.seen[k][1] += left
        after = self.used[self.used.index(k) + 1 :]
        words = len(self.steps[after[0]][1]) if after else _EDIT_WORDS
        came, left = self.seen[k]
        if came >= _TRIAL and (came - left) * words < came * len(self.steps[k][1]):
            self.used.remove(k)


class _Block:
    """Room for a block of pairs, and the counting of bits in which they differ."""

    def __init__(self):
        self.words, self.bits, self.sum = np.empty(_CELLS, dtype=np.uint64), np.empty(_CELLS, dtype=np.uint8), np.empty(_CELLS, dtype=np.uint8)
        self.apart = {t: np.empty(_CELLS, dtype=t) for t in (np.uint16, np.uint32)}

    def left(self, sieve: _Sieve, na: np.ndarray, nb: np.ndarray, rows: slice, columns: slice, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows and columns that the sieve leaves; of one group's pairs each once."""
        shape = (rows.stop - rows.start, columns.stop - columns.start)
        cells = shape[0] * shape[1]
        most_a, most_b = budget(na[rows], percent), budget(nb[columns], percent)
        # a column's highest limits; those of its pairs are looked at when few are left
        most = np.maximum(most_a[-1], most_b)
        gap = np.maximum(0, np.maximum(na[rows.start] - nb[columns], nb[columns] - na[rows.stop - 1]))
        words, bits, total = (x[:cells].reshape(shape) for x in (self.words, self.bits, self.sum))
        ok, left, u, v = None, cells, None, None

        def pairs(flat: np.ndarray) -> np.ndarray:
            """Sets u, v, most and gap; the places of the pairs among all."""
            nonlocal u, v, most, gap
            u, v = np.divmod(flat, shape[1])
            most, gap = np.maximum(most_a[u], most_b[v]), np.abs(na[rows][u] - nb[columns][v])
            u, v = u + rows.start, v + columns.start
            kept = (gap <= most) & (u < v) if same else gap <= most
            u, v, most, gap = u[kept], v[kept], most[kept], gap[kept]
            return flat[kept]

        for k in list(sieve.used):
            q, a, b = sieve.steps[k]
            came, done = left, 0
            if u is None:
                kind = np.uint16 if len(a) < 1024 else np.uint32
                apart, limit = self.apart[kind][:cells].reshape(shape), np.clip(2 * q * most - gap, 0, 64 * len(a)).astype(kind)
                apart[:] = 0
                before = ok
                while done < len(a):
                    for w in range(done, min(done + _WORDS, len(a))):
                        np.bitwise_xor(a[w, rows, None], b[w, None, columns], out=words)
                        if (w - done) % 4 == 0:
                            np.bitwise_count(words, out=total)
                        else:
                            np.bitwise_count(words, out=bits)
                            np.add(total, bits, out=total)  # 256 would count as 0, which only keeps a pair
                        if (w - done) % 4 == 3 or w + 1 == len(a):
                            np.add(apart, total, out=apart)
                    done = min(done + _WORDS, len(a))
                    ok = apart <= limit if before is None else (apart <= limit) & before
                    left = np.count_nonzero(ok)
                    if left <= _DENSE * cells:
                        so_far = apart.ravel()[pairs(np.flatnonzero(ok))].astype(np.int64)
                        break
            else:
                so_far = np.zeros(len(u), dtype=np.int64)
            if u is not None:
                while done < len(a) and len(u):
                    for w in range(done, min(done + _WORDS, len(a))):
                        so_far += np.bitwise_count(a[w].take(u) ^ b[w].take(v))
                    done += _WORDS
                    kept = np.flatnonzero(so_far <= 2 * q * most - gap)
                    if len(kept) < len(u) * 7 // 8:
                        u, v, most, gap, so_far = (x[kept] for x in (u, v, most, gap, so_far))
                kept = so_far <= 2 * q * most - gap
                u, v, most, gap = u[kept], v[kept], most[kept], gap[kept]
                left = len(u)
            sieve.tell(k, came, left)
            if not left:
                break
        if u is None:
            pairs(np.arange(cells) if ok is None else np.flatnonzero(ok))
        return u, v


def _left(a: Tile, b: Tile, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two tiles that all signatures leave; of one tile's pairs each once, and no row with itself."""
    block = _Block()
    for k, (a0, a1, a_bits) in enumerate(a.groups):
        for m, (b0, b1, b_bits) in enumerate(b.groups):
            na, nb, own = a.n[a0:a1], b.n[b0:b1], same and k == m
            if budget(max(na[-1], nb[-1]), percent) < max(nb[0] - na[-1], na[0] - nb[-1]) or (same and m < k):
                continue
            sieve, i = _Sieve(a_bits, b_bits), 0
            while i < len(na):
                # the partners of the next rows, which are of like length, in blocks
                low = max(np.searchsorted(nb, na[i] - budget(na[i], percent)), i + 1 if own else 0)
                high = np.searchsorted(nb, na[i] * 100 // percent + 1, "right")
                step = min(max(_ROWS[0], _CELLS // max(1, high - low)), _ROWS[1], np.searchsorted(na, na[i] + na[i] // 32, "right") - i)
                high = np.searchsorted(nb, na[i + step - 1] * 100 // percent + 1, "right")
                at = low
                while at < high:
                    end = min(at + (_CELLS if max(x for x, _ in sieve.seen) >= _TRIAL else _TRIAL) // step, high)
                    u, v = block.left(sieve, na, nb, slice(i, i + step), slice(at, end), percent, own)
                    if len(u):
                        yield u + a0, v + b0
                    at = end
                i += step


class _Waiting:
    """Pairs by the words that a column of theirs takes, until there are enough of them."""

    def __init__(self):
        self.parts: dict[int, list] = {}
        self.size: dict[int, np.ndarray] = {}

    def add(self, words: int, u: np.ndarray, v: np.ndarray, most: np.ndarray, letters: int) -> bool:
        """Whether these are enough now."""
        self.parts.setdefault(words, []).append((u, v, most))
        self.size[words] = self.size.get(words, 0) + np.array([len(u), letters])
        return bool((self.size[words] >= (_WAITING, _WAITING_LETTERS)).any())

    def take(self, words: int) -> list[np.ndarray]:
        del self.size[words]
        return [np.concatenate(x) for x in zip(*self.parts.pop(words), strict=True)]


def near_pairs(a: Tile, b: Tile, percent: int) -> Iterator[tuple[list[str], list[str], list[int]]]:
    """Lists of (key of a, key of b, distance), different keys within the budget; if b is a, each pair once."""
    fresh, begun = _Waiting(), _Waiting()
    open_share: dict[int, float] = {}  # by words, of the pairs looked at last

    def looked_at(words: int) -> Iterator[tuple[list[str], list[str], list[int]]]:
        """Most pairs can be told from the first letters; the others wait for more of their kind."""
        u, v, most = fresh.take(words)
        if open_share.get(words, 0) < 1 / 2 and len(u) >= _FEW * words:
            found = _distances(a, b, u, v, most, words, 2 * int(most.max()))
            left = found >= 0
            open_share[words] = left.mean()
            u, v, most = u[left], v[left], most[left]
        if len(u) and begun.add(words, u, v, most, int(b.n[v].sum())):
            yield measured(words)

    def measured(words: int) -> tuple[list[str], list[str], list[int]]:
        u, v, most = begun.take(words)
        if len(u) >= _FEW * words:
            d = _distances(a, b, u, v, most, words)
        else:
            d = np.array([edit_distance(a.keys[i], b.keys[j], k) for i, j, k in zip(u.tolist(), v.tolist(), most.tolist(), strict=True)])
        found = d > 0  # the same key may be on both sides
        return [a.keys[i] for i in u[found].tolist()], [b.keys[j] for j in v[found].tolist()], d[found].tolist()

    for u, v in _left(a, b, percent, a is b):
        most = budget(np.maximum(a.n[u], b.n[v]), percent).astype(np.int64)
        words = (most + 64) // 64
        for w in np.unique(words).tolist():
            own = words == w
            if fresh.add(w, u[own], v[own], most[own], int(b.n[v[own]].sum())):
                yield from looked_at(w)
    for w in list(fresh.parts):
        yield from looked_at(w)
    for w in list(begun.parts):
        yield measured(w)
