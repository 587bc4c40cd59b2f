"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

A merge is decided by what stands to its right only as far as a chain of merges of ever higher priority can reach;
`Merges.lookahead` computes the longest such chain from the merge list. Tokens that end further than that from the end of
what has been read are stable and are emitted at once, and since a token boundary splits the encoding of a word into those
of its two sides, the rest starts afresh from there.

Every text is read in pieces (`Transducer.feed`). White space is a restart point: between two words nothing is held, so
whole short words are encoded side by side, and their runs are remembered in a table of bounded size. A word that is longer,
or that a piece's end cuts, goes through a `WordStream`: its state is the unread rest of its characters (what normalisation,
a special token or a contraction could still change), the kind of the open pre-token, and the bytes of at most one window.

Normalisation and splitting follow the tokenizer file: canonical composition, lower case character by character, then
contractions, runs of letters, single digits and runs of other signs; white space is dropped. Memory is constant in the
length of a text, but for a run of combining marks, which composition has to see whole.
"""

from __future__ import annotations

import functools
import heapq
import json
import sys
import unicodedata

import numpy as np
import regex

#: The splitting pattern of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space in the sense of Unicode; str.split() would also split at 0x1C-0x1F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NOT_SPACE = regex.compile(f"[^{SPACE}]+")
_SPLIT = regex.compile(PATTERN)
_INF = np.int32(2**31 - 1)
#: Tails of a normalised run that can become a contraction, and the runs that go on from one piece to the next.
_TAIL = regex.compile(r"'[rvl]?$")
_RUNS = {"letters": regex.compile(r"[\p{L}]+"), "signs": regex.compile(r"[^\s\p{L}\p{N}]+")}
_GAP = regex.compile(f"[{SPACE}]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else the next one above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def words(text: str) -> list[str]:
    """The runs of a text without white space; no token crosses them."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return _NOT_SPACE.findall(text)
    return text.split()


def normal(word: str) -> str:
    if not word.isascii():
        word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
    return word.lower()


@functools.cache
def _joins_left() -> frozenset[str]:
    """The characters of combining class 0 that composition can join to the one before."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(sys.maxunicode + 1)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def starts_afresh(c: str) -> bool:
    """Whether nothing before this character changes how it and what follows are composed."""
    return c.isascii() or (unicodedata.combining(c) == 0 and c not in _joins_left())


class Merges:
    """The merge list as a hash table from pairs of ids to ranks and results, and its sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in letters], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        self._table(pairs)
        self.ranked = {(a << 32) | b: (r, made) for r, (a, b, made) in enumerate(pairs)}
        self.widths = np.zeros(max(self.names) + 1, np.int64)
        for i, t in self.names.items():
            self.widths[i] = len(t.removesuffix("</w>"))
        self.lookahead = self._lookahead(pairs)
        #: Bytes of a word that are held at a time.
        self.window = max(4096, 2 * self.lookahead)

    def _table(self, pairs) -> None:
        bits = 20
        self.shift = np.uint64(64 - bits)
        key = np.array([(a << 32) | b for a, b, _ in pairs], np.uint64)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, _INF, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        self.mask = (1 << bits) - 1
        self.probes = 1
        for r, (k, h) in enumerate(zip(key.tolist(), self._hash(key).tolist())):
            n = 1
            while self.keys[h] != np.uint64(2**64 - 1):
                h, n = (h + 1) & self.mask, n + 1
            self.keys[h], self.rank[h], self.made[h] = k, r, pairs[r][2]
            self.probes = max(self.probes, n)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the table of each pair; no merge: the largest rank."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        h = self._hash(key)
        hit = self.keys[h] == key
        rank, at = np.where(hit, self.rank[h], _INF), h
        open_ = np.flatnonzero(~hit & (self.keys[h] != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            got = self.keys[at[open_]]
            hit = got == key[open_]
            rank[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (got != np.uint64(2**64 - 1))]
        return rank, at

    def _lookahead(self, pairs) -> int:
        """Bytes to the right of a boundary that can still change it.

        Whether (a, b) merges depends on b not being taken by an earlier merge (b, c), which depends on c in turn, and on
        b having been built, which depends on what stood right of b's own parts. Both chains fall in rank, so one pass
        over the merges in rank order finds the longest: reach[t] is the most that merges so far with t on the left look
        ahead, need[t] what the building of t looked ahead.
        """
        size = {int(i): 1 for i in [*self.inner, *self.final]}
        reach: dict[int, int] = {}
        need: dict[int, int] = {}
        for a, b, made in pairs:
            ahead = max(reach.get(b, 0), need.get(b, 0))
            size[made] = size[a] + size[b]
            need[made] = max(need.get(made, 0), ahead)
            reach[a] = max(reach.get(a, 0), size[b] + ahead)
        return max([1, *reach.values(), *need.values()]) + max(size.values())

    def merge(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words whose symbols are given one after another, with their offsets. Each round merges, in every
        word, its pair of lowest rank wherever it stands, from left to right."""
        n = len(offsets) - 1
        word = np.repeat(np.arange(n), np.diff(offsets))
        done_ids, done_words = [], []
        while len(symbols):
            rank, at = np.full(len(symbols), _INF), np.zeros(len(symbols), np.int64)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside], at[inside] = self.find(symbols[inside], symbols[inside + 1])
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, edge), np.diff(np.append(edge, len(word))))
            over = least == _INF
            if over.any():
                done_ids.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, rank, at, least = symbols[keep], word[keep], rank[keep], at[keep], least[keep]
                if not len(symbols):
                    break
            take = rank == least
            pos = np.flatnonzero(take)
            if len(pos) > 1 and (pos[1:] == pos[:-1] + 1).any():  # overlapping pairs of one symbol: every other one
                run = np.concatenate([[True], pos[1:] != pos[:-1] + 1])
                start = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
            symbols[pos] = self.made[at[pos]]
            keep = np.ones(len(symbols), bool)
            keep[pos + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_words)
        out = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=n), out=out[1:])
        return ids[np.argsort(owner, kind="stable")], out

    def run(self, data: bytes, last: bool) -> list[int]:
        """Ids of one window; last: a word ends with it. The pair of lowest rank, the leftmost of equals, is merged first."""
        n = len(data)
        sym = self.inner[np.frombuffer(data, np.uint8)].tolist()
        if last and n:
            sym[-1] = int(self.final[data[-1]])
        after, before, ranked = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranked
        heap = []
        for i in range(n - 1):
            if hit := ranked.get((sym[i] << 32) | sym[i + 1]):
                heap.append((hit[0] << 32) | i)
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            if sym[i] < 0 or (j := after[i]) >= n:
                continue
            hit = ranked.get((sym[i] << 32) | sym[j])
            if not hit or hit[0] != top >> 32:
                continue
            sym[i], sym[j] = hit[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := ranked.get((sym[i] << 32) | sym[k]):
                    heapq.heappush(heap, (hit[0] << 32) | i)
            if (h := before[i]) >= 0 and (hit := ranked.get((sym[h] << 32) | sym[i])):
                heapq.heappush(heap, (hit[0] << 32) | h)
        return [x for x in sym if x >= 0]

    def advance(self, held: bytearray, last: bool) -> list[int]:
        """Takes from held, an open pre-token's bytes, all that is stable, and returns its ids; last: all of it."""
        out: list[int] = []
        while len(held) > self.window or (last and held):
            part = bytes(held[: self.window])
            end = last and len(held) <= self.window
            ids = self.run(part, end)
            if not end:
                sizes = np.cumsum(self.widths[ids])
                stable = int(np.searchsorted(sizes, len(part) - self.lookahead, "right"))
                ids, part = ids[:stable], part[: int(sizes[stable - 1])]
            out += ids
            del held[: len(part)]
        return out


class Interned(dict):
    """Numbers words in the order of their first use; long ones get a number but aren't remembered."""

    #: Characters from which a word isn't remembered.
    LONG = 256

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.n = 0

    def __missing__(self, word):
        n = self.n
        if len(word) < self.LONG:
            self[word] = n
        self.n += 1
        self.fresh.append(word)
        return n


class Ragged:
    """Rows of ids of different lengths, appended in blocks."""

    def __init__(self):
        self.ids, self.at, self.n = np.zeros(1 << 16, np.int32), np.zeros((1 << 14) + 1, np.int64), 0

    def append(self, ids: np.ndarray, offsets: np.ndarray) -> None:
        used, rows = int(self.at[self.n]), len(offsets) - 1
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + rows + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[used : used + len(ids)] = ids
        self.at[self.n + 1 : self.n + rows + 1] = used + offsets[1:]
        self.n += rows

    def rows(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows i one after another, and their lengths."""
        start = self.at[i]
        n = self.at[i + 1] - start
        ends = np.cumsum(n)
        return self.ids[np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


class WordTable:
    """Encodes texts word by word and remembers at most `limit` words; `encode_words` fills in unseen ones."""

    def __init__(self, encode_words, limit: int = 1_200_000):
        self.encode_words, self.limit = encode_words, limit
        self.seen, self.table = Interned(), Ragged()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets."""
        if self.seen.n > self.limit or len(self.table.ids) > 8 * self.limit:
            self.seen, self.table = Interned(), Ragged()
        number, rows, counts = self.seen.__getitem__, [], []
        for text in texts:
            w = words(text)
            counts.append(len(w))
            rows.extend(map(number, w))
        fresh, self.seen.fresh = self.seen.fresh, []
        if fresh:
            self.table.append(*self.encode_words(fresh))
        ids, n = self.table.rows(np.array(rows, np.int64))
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        return ids, total[first]


class WordStream:
    """A run of a text without white space, fed in pieces; ids come out as soon as they are stable."""

    def __init__(self, t: Transducer):
        self.t, self.raw, self.text, self.kind, self.held = t, "", "", None, bytearray()
        self.most = 0  # bytes and characters held at most between two calls

    def feed(self, piece: str) -> list[int]:
        self.raw += piece
        out = self._take(self._cut(), False)
        self.most = max(self.most, len(self.raw) + len(self.text) + len(self.held))
        return out

    def close(self) -> list[int]:
        return self._take(len(self.raw), True)

    def _cut(self) -> int:
        """How much of the raw characters is settled: what follows can't compose with it, and no special token is cut."""
        raw, longest = self.raw, self.t.longest_special
        c = len(raw) - longest
        while c > 0:
            if not starts_afresh(raw[c]):
                c -= 1
                continue
            for i in range(max(0, c - longest + 1), c):
                if any(raw.startswith(x, i) and i + len(x) > c for x in self.t.merges.special):
                    c = i
                    break
            else:
                return c
        return 0

    def _take(self, n: int, end: bool) -> list[int]:
        part, self.raw = self.raw[:n], self.raw[n:]
        out, at = [], 0
        if self.t.special is not None and "<|" in part:
            for m in self.t.special.finditer(part):
                out += self._plain(part[at : m.start()], True)
                out.append(self.t.merges.special[m[0]])
                at = m.end()
        return out + self._plain(part[at:], end)

    def _plain(self, part: str, end: bool) -> list[int]:
        """The next characters of the run between special tokens; end: it ends with them."""
        text, self.text = self.text + normal(part), ""
        merges, out, at = self.t.merges, [], 0
        if self.kind and text:
            m = _RUNS[self.kind].match(text)
            if m:
                self.held += m[0].encode()
                at = m.end()
            if at < len(text):
                out += merges.advance(self.held, True)
                self.kind = None
            else:
                out += merges.advance(self.held, False)
        tokens = [m.span() for m in _SPLIT.finditer(text, at)] if at < len(text) else []
        if tokens and not end:
            tail = _TAIL.search(text, at)
            if tail and any(a == tail.start() for a, _ in tokens[-2:]):
                self.text = text[tail.start() :]
                tokens = [x for x in tokens if x[0] < tail.start()]
            elif (m := [k for k, r in _RUNS.items() if r.fullmatch(text, *tokens[-1])]) and not (tokens[-1][1] - tokens[-1][0] > 1 and text[tokens[-1][0]] == "'" and m[0] == "letters"):
                a, b = tokens.pop()
                out += self.t.whole([text[x:y] for x, y in tokens])
                tokens, self.kind = [], m[0]
                self.held += text[a:b].encode()
                out += merges.advance(self.held, False)
        out += self.t.whole([text[x:y] for x, y in tokens])
        if end:
            out += merges.advance(self.held, True)
            self.kind = None
        return out


class Transducer:
    """The encoder. `feed` takes the next piece of a text, `encode` whole texts side by side."""

    def __init__(self, path: str, remember: int = 200_000):
        self.merges = Merges(path)
        self.special = regex.compile("|".join(regex.escape(x) for x in self.merges.special)) if self.merges.special else None
        self.longest_special = max(map(len, self.merges.special), default=0)
        self.words = WordTable(self.encode_words, limit=remember)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.words.encode(texts)

    def feed(self, state: WordStream | None, piece: str, last: bool) -> tuple[np.ndarray, WordStream | None]:
        """The ids that the next piece of a text settles, and the state to hand on: the word that the piece's end cuts, if
        any. last: the text ends with it."""
        parts: list = []
        if state is not None:
            gap = _GAP.search(piece)
            parts.append(state.feed(piece[: gap.start()] if gap else piece))
            if gap is None and not last:
                return np.array(parts[0], np.int32), state
            parts.append(state.close())
            piece, state = piece[gap.start() :] if gap else "", None
        body = piece
        if not last:
            words_end = max((i for i in range(len(piece) - 1, max(-1, len(piece) - 1 - Interned.LONG), -1) if piece[i] in SPACE), default=None)
            if words_end is None:
                words_end = next((m.start() for m in regex.finditer(f"(?r)[{SPACE}]", piece)), -1)
            body, rest = piece[: words_end + 1], piece[words_end + 1 :]
            if rest:
                state = WordStream(self)
        parts.append(self.encode([body])[0])
        if state is not None:
            parts.append(state.feed(rest))
        return np.concatenate([np.array(x, np.int32) for x in parts]), state

    def _pretokens(self, word: str) -> list:
        if self.special is not None and "<|" in word and self.special.search(word):
            out, at = [], 0
            for m in self.special.finditer(word):
                out += _SPLIT.findall(normal(word[at : m.start()])) + [self.merges.special[m[0]]]
                at = m.end()
            return out + _SPLIT.findall(normal(word[at:]))
        return _SPLIT.findall(normal(word))

    def whole(self, tokens: list[str]) -> list[int]:
        """Ids of whole pre-tokens, one after another."""
        short = all(len(x) < Interned.LONG for x in tokens)
        if short and len(tokens) > 8:
            return self._side_by_side([x.encode() for x in tokens])[0].tolist()
        return [i for x in tokens for i in self.merges.advance(bytearray(x.encode()), True)]

    def _side_by_side(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        m = self.merges
        lens = np.array([len(p) for p in parts], np.int64)
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(lens, out=offsets[1:])
        raw = np.frombuffer(b"".join(parts), np.uint8)
        symbols = m.inner[raw]
        last = offsets[1:][lens > 0] - 1
        symbols[last] = m.final[raw[last]]
        return m.merge(symbols, offsets)

    def encode_words(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that haven't been seen, and offsets. Short ones end inside a window, so all their tokens are stable
        at once; the others are streams."""
        parts: list[bytes] = []
        counts, direct = [], {}
        for w in block:
            if len(w) >= Interned.LONG:
                stream = WordStream(self)
                direct[len(parts)] = [i for a in range(0, len(w), 1 << 16) for i in stream.feed(w[a : a + (1 << 16)])] + stream.close()
                parts.append(b"")
                counts.append(1)
                continue
            tokens = [w.lower()] if w.isascii() and w.isalpha() else self._pretokens(w)
            counts.append(len(tokens))
            for t in tokens:
                if isinstance(t, int):
                    direct[len(parts)] = [t]
                    parts.append(b"")
                else:
                    parts.append(t.encode())
        ids, at = self._side_by_side(parts)
        if direct:
            pieces = [direct[i] if i in direct else ids[at[i] : at[i + 1]].tolist() for i in range(len(parts))]
            at = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) for p in pieces], out=at[1:])
            ids = np.array([x for p in pieces for x in p], np.int32)
        first = np.zeros(len(block) + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        return ids, at[first]


class Pieces:
    """The spelling of every id as bytes, so that runs of ids become text by gathering alone."""

    def __init__(self, spell: dict[int, bytes]):
        n = max(spell, default=-1) + 1
        rows = [spell.get(i, b"") for i in range(n)]
        self.at = np.zeros(n + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=self.at[1:])
        self.data = np.frombuffer(b"".join(rows), np.uint8)

    def spell(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The joined spelling of each run of ids."""
        start = self.at[ids]
        n = self.at[ids + 1] - start
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        out = self.data[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
        cut = ends[offsets].tolist()
        blob = out.tobytes()
        return [blob[a:b] for a, b in zip(cut, cut[1:])]


class TextMachine:
    """Incremental decoder from ids to bytes of text, a run of ids at a time.

    Its state is what the next token needs to know of those before: as the library spells, whether there was one, since a
    tokenizer file without a decoder gives the tokens' own spellings joined by a space; plain, whether a word has ended and
    a space is due, since the encoder drops the original white space. Tokens are bytes, so a character may be cut between
    two runs; `feed` hands on whole bytes and `ByteTextMachine` whole characters.
    """

    def __init__(self, names: dict[int, str], special: set[int] = frozenset(), plain: bool = False):
        self.plain, self.due = plain, False
        if plain:
            back = {c: b for b, c in enumerate(byte_letters())}
            ends = {i: i not in special and t.endswith("</w>") for i, t in names.items()}
            raw = {i: t.encode() if i in special else bytes(back[c] for c in t.removesuffix("</w>")) for i, t in names.items()}
            # a word's end is kept as a space behind it, which is taken back where nothing follows
            self.pieces = Pieces({i: r + b" " * ends[i] for i, r in raw.items()})
            self.ends = np.zeros(len(self.pieces.at), bool)
            self.ends[[i for i, e in ends.items() if e]] = True
        else:
            self.pieces = Pieces({i: b" " + t.encode() for i, t in names.items()})

    def copy(self) -> TextMachine:
        """A machine at the start of a text, with the same tables."""
        out = object.__new__(TextMachine)
        out.__dict__ |= self.__dict__ | {"due": False}
        return out

    def feed(self, ids: np.ndarray) -> bytes:
        return self.feed_runs(ids, np.array([0, len(ids)]), [self])[0]

    def feed_runs(self, ids: np.ndarray, offsets: np.ndarray, machines: list[TextMachine]) -> list[bytes]:
        """The bytes of many runs at once, each continuing its own machine."""
        out = self.pieces.spell(ids, offsets)
        for r, (m, a, b) in enumerate(zip(machines, offsets.tolist(), offsets[1:].tolist())):
            if a == b:
                continue
            if not self.plain:
                if not m.due:
                    out[r], m.due = out[r][1:], True
                continue
            ends = bool(self.ends[ids[b - 1]])
            out[r] = b" " * m.due + (out[r][:-1] if ends else out[r])
            m.due = ends
        return out


class ByteTextMachine:
    """A plain TextMachine that hands on whole characters: it also holds an unfinished UTF-8 sequence, three bytes at most.
    Malformed bytes become U+FFFD."""

    def __init__(self, machine: TextMachine):
        import codecs

        self.machine = machine
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.utf8.decode(self.machine.feed(np.asarray(ids, np.int64)))

    def finish(self) -> str:
        return self.utf8.decode(b"", True)
