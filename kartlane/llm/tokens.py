"""Encoding of whole texts with a public tokenizer file, exact and fast.

``UnitEncoder`` cuts a text at places where no token of the tokenizer can reach
across (a white-space byte between two other bytes), encodes each distinct unit
once per worker and joins the ids. The merges of units of plain characters run
in ``tiktoken`` over the file's own merge list, those of others in the tokenizer
itself. Texts where such cuts are not certain are encoded whole, long ones by
``tree_encode``.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

_UNIT = re.compile(rb"[ \n]?[^ \n]+")
_OTHER_SPACE = bytes([9, 11, 12, 13, 28, 29, 30, 31])
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1[\x9a\xa0][\x80\x8e]|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_PLAIN_UNIT = re.compile(r"[ \n]?[!-~À-ÖØ-öø-ÿ]{1,64}")
_WIDE_LEAD = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def load(path: str):
    """The tokenizer of a file, without its truncation and padding."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class ByteMerges:
    """Merges of a byte-level BPE file, run in ``tiktoken``; for texts whose white space is single and not at the end.

    ``tiktoken`` merges two neighbours whenever their joined bytes are a token, the
    tokenizer only if they are that token's own pair. Both do the same if each token,
    encoded by itself, gives itself: what happens between a token's two ends does not
    depend on what lies around them, so it is always made from the same last pair.
    ``of`` looks that up and gives nothing for a file where it does not hold.
    """

    _CUT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"  # as ByteLevel's for such texts

    def __init__(self, vocab: dict[bytes, int], merges: list[bytes]):
        import tiktoken
        ranks = {bytes([x]): x for x in range(256)} | {t: 256 + j for j, t in enumerate(merges)}
        self.ids = np.array([vocab[t] for t in ranks], "<u4")
        self.size = np.fromiter(map(len, ranks), np.int64, len(ranks))
        self.bpe = tiktoken.Encoding("bytes", pat_str=self._CUT, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str, tok) -> ByteMerges | None:
        import json
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre, byte = file["model"], file.get("pre_tokenizer") or {}, byte_alphabet()
        if (file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
                or any("<|" not in t["content"] for t in file.get("added_tokens") or [])):  # as ``UnitEncoder.units`` takes them to be
            return None
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        tokens = {c: model["vocab"].get(c) for c in [*byte, *merges]}
        if len(tokens) < len(byte) + len(merges) or any([x.id for x in tok.model.tokenize(t)] != [i] for t, i in tokens.items()):
            return None
        raw = {t: bytes(byte[c] for c in t) for t in tokens}
        return cls({raw[t]: i for t, i in tokens.items()}, [raw[t] for t in merges])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``text``, and how many bytes come before each of them and, at last, in all."""
        got = np.array(self.bpe.encode_ordinary(text), np.int64)
        return self.ids[got], np.append(0, np.cumsum(self.size[got]))


class UnitEncoder:
    """Exact ids of UTF-8 texts for byte-level BPE; units keep their leading space or line feed.

    A worker keeps at most ``most`` units, or those of one call's 200 texts if they are more.
    """

    def __init__(self, path: str, separator: str, leaf: int = 4096, most: int = 500_000):
        self.tok, self.leaf, self.most = load(path), leaf, most
        self.sep, self.sep_id = separator, self.tok.token_to_id(separator)
        self.merges = ByteMerges.of(path, self.tok)
        self.cache: dict[bytes, bytes] = {}

    def units(self, raw: bytes) -> list[bytes] | None:
        """The text's units, or None where cutting it is not certain to be exact."""
        if b"<|" in raw:
            return None
        if len(raw.translate(None, _OTHER_SPACE)) != len(raw):
            return None
        if any(x in raw for x in _WIDE_LEAD) and _WIDE_SPACE.search(raw):
            return None
        found = _UNIT.findall(raw)
        return found if sum(map(len, found)) == len(raw) else None

    def _learn_plain(self, units: list[bytes]) -> list[bytes]:
        """Learn the units of plain characters; returns the others."""
        strings = b"\0".join(units).decode().split("\0")  # a unit with this byte is not plain
        if len(strings) != len(units):
            strings = [u.decode() for u in units]
        plain = list(map(bool, map(_PLAIN_UNIT.fullmatch, strings)))
        # A unit without white space begins a text; here a line feed, which is always a token of its own, precedes it.
        rest, own = [u for u, p in zip(units, plain) if not p], [u for u, p in zip(units, plain) if p]
        bare = np.fromiter((u[0] not in b" \n" for u in own), bool, len(own))
        text = "".join([s if s[0] in " \n" else "\n" + s for s, p in zip(strings, plain) if p])
        ids, at = self.merges.encode(text)
        end = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + bare)
        last = np.searchsorted(at, end)
        if not np.array_equal(at[last], end):  # cannot happen between such units; kept as a guard
            return units
        raw, first = ids.tobytes(), np.append(0, last[:-1]) + bare
        self.cache.update(zip(own, map(raw.__getitem__, map(slice, (4 * first).tolist(), (4 * last).tolist()))))
        return rest

    def _learn(self, units: list[bytes]) -> None:
        if self.merges:
            units = [u for at in range(0, len(units), 65536) for u in self._learn_plain(units[at:at + 65536])]
        short = [u for u in units if len(u) <= self.leaf]
        for at in range(0, len(short), 4096):
            part = short[at:at + 4096]
            ids = np.array(self.tok.encode(self.sep.join(u.decode() for u in part), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(ids == self.sep_id)
            if len(cut) != len(part) - 1:  # cannot happen for units without "<|"; kept as a guard
                for u in part:
                    self.cache[u] = np.array(self.tok.encode(u.decode(), add_special_tokens=False).ids, "<u4").tobytes()
                continue
            raw, cut = ids.tobytes(), (4 * cut).tolist()
            for u, a, b in zip(part, [0, *(c + 4 for c in cut)], [*cut, len(raw)]):
                self.cache[u] = raw[a:b]
        for u in units:
            if len(u) > self.leaf:
                self.cache[u] = tree_encode(self.tok, u.decode(), self.leaf).tobytes()

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        known = self.cache
        for at in range(0, len(raws), 200):
            cut = [self.units(r) for r in raws[at:at + 200]]
            every = set().union(*filter(None, cut))
            fresh = [u for u in every if u not in known]
            if len(known) + len(fresh) > self.most:  # begins anew with all units of these texts
                known.clear()
                fresh = list(every)
            self._learn(fresh)
            for r, c in zip(raws[at:at + 200], cut):
                if c is not None:
                    out.append(b"".join(map(known.__getitem__, c)))
                else:
                    out.append(tree_encode(self.tok, r.decode(), self.leaf).tobytes())
        return out


def tree_encode(tok, text: str, leaf: int = 4096, agree: int = 2) -> np.ndarray:
    """Ids of one text by tree concatenation.

    The text is halved down to leaves of at most ``leaf`` code points, which are
    encoded together. Going up, a window of tokens around each join is encoded
    anew; it doubles until its first and last ``agree`` tokens equal those that
    both sides have there (a side it has used up needs no agreement). Byte-pair
    tokens that agree at an edge are joined by a pair that was valid before, so
    the result equals the encoding of the whole.
    """
    if len(text) <= leaf:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4")
    n = 1 << (max(1, -(-len(text) // leaf)) - 1).bit_length()
    cuts = [len(text) * i // n for i in range(n + 1)]

    def arrays(e, at):
        spans = np.array(e.offsets, np.int64).reshape(-1, 2) + at
        return np.array(e.ids, "<u4"), spans[:, 0], spans[:, 1]

    encoded = tok.encode_batch([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
    nodes = [arrays(e, a) + (a, b) for e, a, b in zip(encoded, cuts, cuts[1:])]
    while len(nodes) > 1:
        nodes = [_join(tok, text, x, y, agree, arrays) for x, y in zip(nodes[::2], nodes[1::2])]
    return nodes[0][0]


def _join(tok, text, x, y, agree, arrays):
    xi, xs, xe, xa, xb = x
    yi, ys, ye, ya, yb = y
    width = 16  # tokens; covers the strings of special tokens, which have 13 and 15 characters
    while True:
        left, right = max(0, len(xi) - width), min(len(yi), width)
        # An edge lies between characters and not behind white space: how a run of white space is cut
        # depends on what follows the run, so such an edge would say nothing about the side beyond it.
        while left > 0 and (xe[left - 1] > xs[left] or text[xs[left] - 1].isspace()):
            left -= 1
        while 0 < right < len(yi) and (ye[right - 1] > ys[right] or text[ye[right - 1] - 1].isspace()):
            right += 1
        a = xa if left == 0 else int(xs[left])
        b = yb if right == len(yi) else int(ye[right - 1])
        wi, ws, we = arrays(tok.encode(text[a:b], add_special_tokens=False), a)
        k, m = min(agree, len(xi) - left), min(agree, right)
        fits_left = left == 0 or len(wi) >= k and np.array_equal(wi[:k], xi[left:left + k])
        fits_right = right == len(yi) or len(wi) >= m and np.array_equal(wi[len(wi) - m:], yi[right - m:right])
        if fits_left and fits_right:
            return (np.concatenate([xi[:left], wi, yi[right:]]), np.concatenate([xs[:left], ws, ys[right:]]),
                    np.concatenate([xe[:left], we, ye[right:]]), xa, yb)
        width *= 2


class ByteDecoder:
    """Text of byte-level BPE ids, as the tokenizer's ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, path: str):
        tok = load(path)
        byte = byte_alphabet()
        vocab = tok.get_vocab(with_added_tokens=True)
        self.table = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.table[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ENCODERS: dict = {}


def encoder(kind, path: str, *more):
    """One encoder of a class and file per worker process, so that its words stay known from task to task."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path, *more)
    return _ENCODERS[kind, path]


_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_PARTS = re.compile(_PLAIN.pattern + r"|\n")
_END = "\x01"


class WordEncoder:
    """Exact ids for tokenizer files of BPE with word ends that drop white space.

    Words are cut and numbered by Arrow's kernels; each distinct word is encoded
    once per worker. The merges of plain words (Latin-1 letters, digits, ASCII
    marks but the apostrophe) run in ``tiktoken`` over the file's own merge list
    with ``\\x01`` for a word's end; any other word goes through the tokenizer itself.
    A worker keeps at most ``most`` words, or those of one call if they are more: half of them
    in a table that begins anew when it is full, half in the one before it, from which words
    that are met again come back. Each 64 bytes of words and ids count as one more word.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import json

        import tiktoken
        self.path, self.tok, self.most = path, None, most  # the tokenizer itself is loaded when a word needs it
        model = json.load(open(path, encoding="utf-8"))["model"]
        byte = byte_alphabet()

        def raw(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(byte[c] for c in body) + (_END.encode() if body != token else b"")

        ranks = {bytes([x]): x for x in range(256)} | {bytes([x, 1]): 256 + x for x in range(256) if x != 1}
        for j, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw(a) + raw(b), 512 + j)
        own = {raw(t): i for t, i in model["vocab"].items()}
        self.ids = np.zeros(512 + len(model["merges"]), "<u2")
        self.ends = np.zeros(len(self.ids), bool)
        for t, r in ranks.items():
            self.ids[r], self.ends[r] = own.get(t, 0), t.endswith(b"\x01")
        self.bpe = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0  # what the words of ``cache`` count

    def _learn(self, words: list[bytes]) -> None:
        if not words:
            return
        text = b"\n".join(words).decode()  # no word holds white space
        strings = text.split("\n")
        parts = _PARTS.findall(text)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.append(np.flatnonzero(np.fromiter(map("\n".__eq__, parts), bool, len(parts))), len(parts))
        size[ends[:-1]] = 0
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        total = np.append(0, np.cumsum(size))
        covered = np.diff(total[ends], prepend=0)
        fine = (covered == length) & (length <= 64)
        if "<|" in text:
            fine &= ["<|" not in w for w in strings]
        rest = [w for w, f in zip(words, fine) if not f] if not fine.all() else []
        if rest:
            words = [w for w, f in zip(words, fine) if f]
            kept = np.repeat(fine, np.diff(ends, prepend=-1))[:len(parts)]
            parts = [p for p, k in zip(parts, kept) if k]
        parts = [p for p in parts if p != "\n"]
        counts = (np.diff(ends, prepend=-1) - 1)[fine]
        if words:
            got = np.array(self.bpe.encode_ordinary(_END.join(parts).lower() + _END), np.int64)
            last = np.flatnonzero(self.ends[got])[np.cumsum(counts) - 1] + 1
            raw, cut = self.ids[got].tobytes(), (2 * last).tolist()
            self.cache.update(zip(words, map(raw.__getitem__, map(slice, [0, *cut[:-1]], cut))))
        if rest and self.tok is None:
            self.tok = load(self.path)
        for w in rest:
            s = w.decode()
            self.cache[w] = tree_encode(self.tok, s).astype("<u2").tobytes()

    @staticmethod
    def _counts(words, ids) -> int:
        """What these words count; ids that are not known yet are taken to be as long as the word."""
        return len(words) + sum(len(w) + len(w if p is None else p) for w, p in zip(words, ids)) // 64

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string column (null: empty) in one array, and where each row begins and ends."""
        import pyarrow as pa
        import pyarrow.compute as pc
        lists = pc.ascii_split_whitespace(column.fill_null(""))
        bounds = np.asarray(lists.offsets).astype(np.int64)
        words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        code = np.asarray(words.indices)
        names = words.dictionary.cast(pa.large_binary() if pa.types.is_large_string(words.dictionary.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.cache[b""] = b""
        parts = list(map(self.cache.get, names))
        missed = [i for i, p in enumerate(parts) if p is None]
        if missed:
            words = [names[i] for i in missed]
            back = list(map(self.older.get, words))
            fresh = [w for w, p in zip(words, back) if p is None]
            counts = self._counts(words, back)
            if self.held + counts > self.most // 2:  # a new table with this batch's words
                self.older, self.cache = self.cache, {w: p for w, p in zip(names, parts) if p is not None}
                self.held = counts + self._counts(self.cache.keys(), self.cache.values())
            else:
                self.held += counts
            self.cache.update((w, p) for w, p in zip(words, back) if p is not None)
            self._learn(fresh)
            for i, w in zip(missed, words):
                parts[i] = self.cache[w]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        flat = np.frombuffer(b"".join(parts), "<u2")
        start = np.cumsum(size) - size
        n = size[code]
        end = np.cumsum(n)
        ids = flat[np.repeat(start[code] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        return ids, np.concatenate([[0], end])[bounds]


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}
