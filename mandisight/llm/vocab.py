"""Public tokenizer files and library encoding of many texts at once.

Byte level: tiktoken with the ranks of the JSON file, where its ids ascend with
its merges (tests compare every code point with the tokenizers library). Texts
that hold the string of an added token go through the library's own ``encode``.

Word level: white space carries no id, so a text is cut at ASCII white space
and the distinct runs of a batch are split into pre-tokens by Arrow's regular
expressions and encoded in one pass of tiktoken over the ranks of the file.
Runs beyond plain Latin characters, and texts with special-token strings, go
through the library's own ``encode``.

``encode_texts`` cuts texts at their "plain gaps" for encoders of single runs:
no pre-token of the byte-level pattern crosses one space or line feed between
two characters that are not white space. Runs that are not plain (other white
space at an end) send their whole document through a plain encoder.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from mandisight.llm.common import gather_runs, offsets_of

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

#: Bytes of items and ids that a worker remembers (about); beyond it the older half is forgotten.
MAX_CACHED_BYTES = 64 << 20
#: Bytes that an entry takes besides its text and ids (dictionary slot, string header, places).
ENTRY_BYTES = 180

# The split patterns stated in the two tokenizer files (the
# byte-level one is the pre-tokenizer's built-in pattern).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Characters that are their own NFC form, lower-case one by one and hold no white space.
_SIMPLE = r"^[\x21-\x7e\x{c0}-\x{ff}]*$"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine (every worker has the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def model_file(path: str) -> dict:
    """The parsed file; not kept, since a worker needs it only to build its tables."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def library(path: str):
    """The library's tokenizer with truncation and padding off."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: ids of several items, one after the other, and how many ids each item has.
Ragged = tuple[np.ndarray, np.ndarray]


class RunCache:
    """Ids of the items seen so far, as one flat array with lengths."""

    def __init__(self, encode: Callable[[list], Ragged], limit: int = MAX_CACHED_BYTES):
        self.encode, self.limit = encode, limit
        self.index: dict = {}
        self.held = 0
        self.flat, self.lengths, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget_older_half(self) -> None:
        keep = len(self.index) // 2
        newer = list(itertools.islice(self.index, len(self.index) - keep, None))
        at = np.arange(len(self.index) - keep, len(self.index))
        self.flat, self.lengths = self.gather(at), self.lengths[at]
        self.starts = offsets_of(self.lengths)[:-1]
        self.index = dict(zip(newer, range(keep), strict=True))
        self.held = sum(map(len, newer)) + ENTRY_BYTES * keep + 4 * len(self.flat)

    def lookup(self, items: list) -> np.ndarray:
        """Place of every (distinct) item; the new ones are encoded together. Places hold until the next call."""
        if self.held > self.limit:
            self._forget_older_half()
        index = self.index
        new = [x for x in items if x not in index]
        if new:
            flat, lengths = self.encode(new)
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.held += sum(map(len, new)) + ENTRY_BYTES * len(new) + 4 * len(flat)
            self.flat = np.concatenate([self.flat, flat.astype(np.int32, copy=False)])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.starts = offsets_of(self.lengths)[:-1]
        return np.fromiter(map(index.__getitem__, items), np.int64, len(items))

    def gather(self, at: np.ndarray) -> np.ndarray:
        return gather_runs(self.flat, self.starts[at], self.lengths[at])


def split_and_encode(runs: list[str], pattern, pieces: RunCache) -> Ragged:
    """Ids of runs by way of their distinct pre-tokens."""
    split = list(map(pattern.findall, runs))
    counts = np.fromiter(map(len, split), np.int64, len(split))
    order: dict[str, int] = {}
    codes = np.fromiter((order.setdefault(p, len(order)) for ps in split for p in ps), np.int64, int(counts.sum()))
    at = pieces.lookup(list(order))[codes] if len(codes) else codes
    cuts = offsets_of(pieces.lengths[at])[offsets_of(counts)]
    return pieces.gather(at), np.diff(cuts)


# White space at an end (but for one line feed before a word), an empty run, or the start of special-token text.
_WS = r"\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"^\n?$|^\n[{_WS}]|^[{_WS.replace('20', '09', 1)}\x0b-\x20]|[{_WS}]$|<\|"


def used_codes(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes (below ``n``) that occur, ascending, and the place of each of ``codes`` among them."""
    mark = np.zeros(n, bool)
    mark[codes] = True
    return np.flatnonzero(mark), (np.cumsum(mark) - 1)[codes]


def with_whole(flat: np.ndarray, per_doc: np.ndarray, odd_doc: np.ndarray, whole: Callable[[int], np.ndarray]) -> Ragged:
    """Put the ids of whole documents (``odd_doc``, without ids so far) in their places."""
    if not odd_doc.any():
        return flat, per_doc
    cuts, pieces, lengths = offsets_of(per_doc), [], per_doc.copy()
    done = 0
    for i in np.flatnonzero(odd_doc):
        ids = whole(i)
        pieces += [flat[cuts[done]:cuts[i]], ids]
        lengths[i], done = len(ids), i
    pieces.append(flat[cuts[done]:])
    return np.concatenate(pieces).astype(np.int32, copy=False), lengths


def encode_texts(texts: list, cache: RunCache, whole: Callable[[str], np.ndarray]) -> Ragged:
    """Ids of many texts as (flat int32 ids, ids per text). Null counts as empty.

    Runs after the first keep the space before them (byte level).
    """
    texts = [t or "" for t in texts]
    # A single line feed between words is a run's first character, so that runs do not span lines. A space that
    # was there before it leaves an empty run, which is odd.
    parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
    ends = parts.offsets.to_numpy()
    coded = pc.dictionary_encode(parts.flatten())
    distinct = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    odd = pc.match_substring_regex(coded.dictionary, _ODD).to_numpy(zero_copy_only=False)
    odd_doc = np.add.reduceat(odd[codes], ends[:-1]) > 0 if len(codes) else np.zeros(len(texts), bool)
    # The first run of a text has no space before it: give it a code of its own.
    used, back = used_codes(codes[ends[:-1]], len(distinct))
    runs = [r if r[:1] == "\n" else " " + r for r in distinct] + [distinct[i] for i in used]
    codes = codes.copy()
    codes[ends[:-1]] = len(distinct) + back
    live = ~np.repeat(odd_doc, np.diff(ends))
    wanted, back = used_codes(codes[live], len(runs))
    at = cache.lookup([runs[i] for i in wanted])
    run_len, run_start = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    run_len[live], run_start[live] = cache.lengths[at][back], cache.starts[at][back]
    flat = gather_runs(cache.flat, run_start, run_len)
    per_doc = np.add.reduceat(run_len, ends[:-1]) if len(texts) else np.zeros(0, np.int64)
    return with_whole(flat, per_doc, odd_doc, lambda i: whole(texts[i]))


def ragged(ids: list) -> Ragged:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    if len(ids) and isinstance(ids[0], np.ndarray):
        return np.concatenate(ids).astype(np.int32, copy=False), lengths
    return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths


@functools.cache
def byte_ranks(path: str):
    """tiktoken's encoder with the ranks of a byte-level vocabulary file, or None where its ids do not follow its merges."""
    import tiktoken

    merged = [c for _, _, c in merge_ranks(path)[1]]
    if any(a >= b for a, b in itertools.pairwise(merged)):
        return None
    plain, file = token_bytes(path), model_file(path)
    special = {t["id"] for t in file["added_tokens"]}
    return tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, special_tokens={},
                             mergeable_ranks={plain[i]: i for i in file["model"]["vocab"].values() if i not in special})


def plain_ids(path: str) -> Callable[[str], list[int]]:
    """text -> ids of a byte-level vocabulary, the strings of special tokens being plain text."""
    ranks = byte_ranks(path)
    if ranks is not None:
        return ranks.encode_ordinary
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def _byte_encoder(path: str) -> Callable[[list], Ragged]:
    plain = plain_ids(path)
    special = [t["content"] for t in model_file(path)["added_tokens"]]

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return library(path).encode(text, add_special_tokens=False).ids
        return plain(text)

    return lambda texts: ragged([np.array(ids(t) if t else [], np.int32) for t in texts])


#: Ends a pre-token of the word-level vocabulary; no simple run holds it.
_END = "\0"


@functools.cache
def word_ranks(path: str):
    """tiktoken's encoder of a word-level vocabulary file, and which ids end a word; None where its ids do not
    follow its merges.

    The end of a word is written as a byte of its own. The ids of single bytes with that end come before all merged
    ids, so the last byte of a word takes its end before anything else merges, as in the library's model.
    """
    import tiktoken

    file = model_file(path)
    words, suffix = file["model"]["vocab"], file["model"]["end_of_word_suffix"]
    back = {c: b for b, c in byte_alphabet().items()}
    special = {t["content"] for t in file["added_tokens"]}
    ranks = {bytes(back[c] for c in w.removesuffix(suffix)) + _END.encode() * w.endswith(suffix): i
             for w, i in words.items() if w not in special}
    merged = [c for _, _, c in merge_ranks(path)[1]]
    first = max(i for w, i in ranks.items() if len(w.removesuffix(_END.encode()) or w) == 1)
    if any(a >= b for a, b in itertools.pairwise([first, *merged])):
        return None
    ends = np.zeros(max(ranks.values()) + 1, bool)
    ends[[i for w, i in ranks.items() if len(w) > 1 and w.endswith(_END.encode())]] = True
    return tiktoken.Encoding("word-level", pat_str=rf"[^{_END}]+{_END}", special_tokens={}, mergeable_ranks=ranks), ends


class WordEncoder:
    """Texts to ids of the word-level vocabulary (lower case, white space dropped)."""

    # The pattern for lower-case runs without white space.
    _PIECE = WORD_PATTERN.replace(r"[^\s", "[^")

    def __init__(self, path: str):
        self.path, self.ranks = path, word_ranks(path)
        self.others = RunCache(self._other_ids)

    def _other_ids(self, runs: list[str]) -> Ragged:
        return ragged([library(self.path).encode(r, add_special_tokens=False).ids for r in runs])

    def _simple_ids(self, runs: pa.Array) -> Ragged:
        """Ids of simple runs: one pass over all their pre-tokens, each with its end."""
        lowered, words = pc.utf8_lower(runs), pc.utf8_is_alpha(runs)
        split = pc.replace_substring_regex(lowered.filter(pc.invert(words)), f"({self._PIECE})", rf"\1{_END}")
        whole = pc.binary_join_element_wise(lowered.filter(words), pa.scalar(_END, runs.type), pa.scalar("", runs.type))
        order = np.concatenate([np.flatnonzero(words), np.flatnonzero(pc.invert(words))])
        marked = pa.concat_arrays([whole, split])
        ranks, ends = self.ranks
        ids = np.array(ranks.encode_ordinary("".join(marked.to_pylist())), np.int32)
        # A pre-token's last id, and only that, ends a word.
        piece_cuts = np.concatenate([[0], np.flatnonzero(ends[ids]) + 1])
        pieces = offsets_of(pc.count_substring(marked, _END).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = piece_cuts[pieces]
        starts, lengths = np.empty(len(runs), np.int64), np.empty(len(runs), np.int64)
        starts[order], lengths[order] = cuts[:-1], np.diff(cuts)
        return gather_runs(ids, starts, lengths), lengths

    def _run_ids(self, runs: pa.Array) -> Ragged:
        """Ids of distinct runs, in their order."""
        simple = pc.match_substring_regex(runs, _SIMPLE) if self.ranks else pa.array(np.zeros(len(runs), bool))
        plain = simple.to_numpy(zero_copy_only=False)
        flat, lengths = self._simple_ids(runs.filter(simple)) if plain.any() else ragged([])
        if plain.all():
            return flat, lengths
        found = self.others.lookup(runs.filter(pc.invert(simple)).to_pylist())
        more, counts = self.others.gather(found), self.others.lengths[found]
        both, starts = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        both[plain], both[~plain] = lengths, counts
        starts[plain], starts[~plain] = offsets_of(lengths)[:-1], len(flat) + offsets_of(counts)[:-1]
        return gather_runs(np.concatenate([flat, more]), starts, both), both

    def __call__(self, texts: list | pa.Array) -> Ragged:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = pc.fill_null(column, "")
        parts = pc.ascii_split_whitespace(column)
        coded, ends = pc.dictionary_encode(parts.flatten()), parts.offsets.to_numpy().astype(np.int64)
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        odd_doc = np.zeros(len(column), bool)
        if len(codes):
            odd = pc.match_substring(distinct, "<|").to_numpy(zero_copy_only=False)
            odd_doc = np.add.reduceat(odd[codes], ends[:-1]) > 0
        flat, lengths = self._run_ids(distinct)
        run_len = lengths[codes]
        run_len[np.repeat(odd_doc, np.diff(ends))] = 0
        flat = gather_runs(flat, offsets_of(lengths)[:-1][codes], run_len)
        per_doc = np.add.reduceat(run_len, ends[:-1]) if len(column) else np.zeros(0, np.int64)
        return with_whole(flat, per_doc, odd_doc, lambda i: np.array(
            library(self.path).encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.int32))


@functools.cache
def library_encoder(path: str, words: bool) -> Callable[[list], Ragged]:
    """texts -> (flat ids, ids per text), equal to the library's encode."""
    return WordEncoder(path) if words else _byte_encoder(path)


def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary (special tokens: their text)."""
    model = model_file(path)
    back = {c: b for b, c in byte_alphabet().items()}
    size = 1 + max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])])
    out = [b""] * size
    for word, i in model["model"]["vocab"].items():
        out[i] = bytes(back[c] for c in word)
    for t in model["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def merge_ranks(path: str) -> tuple[dict[str, int], Iterable[tuple[int, int, int]]]:
    """Vocabulary, and (left id, right id, merged id) in rank order."""
    model = model_file(path)["model"]
    vocab = model["vocab"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return vocab, ((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)
