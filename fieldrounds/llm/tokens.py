"""Token counts of a byte-level merge vocabulary, by rank-synchronous merging of arrays.

Texts are cut into pre-tokens. The distinct pre-tokens of a batch lie as one ragged array: all symbols in a row, and the number of
the sequence each belongs to. In every round each sequence's pair of lowest rank is looked up, all its places are merged at once
in all sequences (of places that overlap, as in ``aaa``, every other one from the left), and sequences without a known pair leave. What is
left of a sequence's symbols is its count. That equals merging place by place because a merge's result takes part in later ranks only, which
``Merges`` checks when it reads a file.

The vocabulary file is read on the driver and its arrays (some 25 bytes a merge, so about 1 MB for 50,000) are broadcast. Counts of pre-tokens are
kept between batches until there are ``KEPT``; then they are forgotten and counted again where needed.

Cases: a null text counts as an empty one: 0 bytes and 0 tokens. A file's special strings are cut out first and count one token each. Repeated rows are
counted one by one, null ids carried as null. An empty table gives an empty result. Only the id and the text are read, so other columns may have any
name. A very long text is cut, at places where no pre-token can reach over, into pieces of about ``PIECE`` characters, so
that it needs the memory of its text and of one piece; a single pre-token is one sequence however long it is, and takes a round per distinct rank.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

# Fixed value: how byte-level vocabularies cut text (the class of white space by its Unicode property).
PRE_TOKENS = regex.compile(r" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
SAFE_CUT = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
PIECE, KEPT = 1 << 20, 1 << 19
NONE = np.iinfo(np.int32).max


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Merges:
    """Arrays of a vocabulary: the symbol of each byte, and rank and result of each pair."""

    def __init__(self, first: np.ndarray, pairs: np.ndarray, results: np.ndarray, size: int, special: list[str]):
        order = np.argsort(pairs, kind="stable")
        self.first, self.size, self.special = first, size, special
        self.pairs, self.ranks, self.results = pairs[order], order.astype(np.int32), results

    @classmethod
    def load(cls, path: str) -> "Merges":
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, cut = said["model"], said["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
                 and said["normalizer"] is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        odd = [t for t in said["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if not plain or odd:
            raise ValueError(f"not a plain byte-level merge vocabulary: {path}")
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, result = (np.array([ids[x] for x in side], np.int64) for side in ([m[0] for m in merges], [m[1] for m in merges], ["".join(m) for m in merges]))
        first = np.array([ids[c] for c in byte_names()], np.int64)
        size = max(ids.values()) + 1
        made = np.full(size, -1, np.int64)
        made[result] = np.arange(len(result))
        rank = np.arange(len(result))
        if len(np.unique(result)) < len(result) or (made[left] >= rank).any() or (made[right] >= rank).any():
            raise ValueError(f"a merge comes before its parts: {path}")
        special = sorted((t["content"] for t in said["added_tokens"]), key=lambda t: (-len(t), t))
        return cls(first, left * size + right, result, size, special)

    def plain(self) -> tuple:
        """The arguments that make it again, for a broadcast."""
        pairs = np.empty_like(self.pairs)
        pairs[self.ranks] = self.pairs
        return self.first, pairs, self.results, self.size, self.special

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; ``NONE`` for a pair that is never merged."""
        out = np.full(len(left), NONE, np.int32)
        if len(self.pairs):
            key = left * self.size + right
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            known = self.pairs[at] == key
            out[known] = self.ranks[at[known]]
        return out


def surviving(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """The number of symbols each sequence of a ragged array keeps once nothing can be merged."""
    count = lengths.astype(np.int64).copy()
    seq = np.repeat(np.arange(len(lengths)), lengths)
    sym = symbols.astype(np.int64)
    rank = np.full(len(sym), NONE, np.int32)               # of the pair that begins at each place
    inner = np.flatnonzero(seq[:-1] == seq[1:])
    rank[inner] = merges.rank_of(sym[inner], sym[inner + 1])
    while len(sym):
        begins = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        size = np.diff(np.append(begins, len(seq)))
        lowest = np.minimum.reduceat(rank, begins)
        going = lowest < NONE
        if not going.all():                                 # finished sequences leave
            stay = np.repeat(going, size)
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            lowest, size = lowest[going], size[going]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(lowest, size))
        # Of hits that overlap, every other one from the left; a run of them never leaves its sequence.
        new_run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        place = np.arange(len(hit))
        hit = hit[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]
        sym[hit] = merges.results[rank[hit]]
        gone = np.zeros(len(sym), bool)
        gone[hit + 1] = True
        np.subtract.at(count, seq[hit], 1)
        kept = np.cumsum(~gone) - 1
        sym, seq, rank = sym[~gone], seq[~gone], rank[~gone]
        hit = kept[hit]
        near = np.concatenate([hit, hit[hit > 0] - 1])
        rank[near] = NONE
        near = near[near + 1 < len(sym)]
        near = near[seq[near] == seq[near + 1]]
        rank[near] = merges.rank_of(sym[near], sym[near + 1])
    return count


def counts(words: list[str], merges: Merges) -> list[int]:
    """Tokens of each pre-token."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    return surviving(merges.first[flat], np.array([len(r) for r in raw], np.int64), merges).tolist()


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut where no pre-token reaches over."""
    at = 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Counter:
    """Counts tokens of texts; keeps the counts of pre-tokens it has met."""

    def __init__(self, merges: Merges, kept: int = KEPT):
        self.merges, self.known, self.kept = merges, {}, kept
        self.special = regex.compile("|".join(regex.escape(s) for s in merges.special)) if merges.special else None

    def parts(self, text: str | None) -> tuple[list[str], int]:
        """What lies between the special strings, and how many of these there are."""
        if not text:
            return [], 0
        if self.special is None:
            return [text], 0
        between = self.special.split(text)
        return between, len(between) - 1

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > self.kept:
                self.known.clear()
                new = list(words)
            self.known.update(zip(new, counts(new, self.merges)))

    def tokens(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. New pre-tokens of about ``PIECE`` characters of text are merged together."""
        out = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            self.learn(set().union(*[w for _, w in held]))
            get = self.known.__getitem__
            for i, w in held:
                out[i] += sum(map(get, w))
            held.clear()

        for i, text in enumerate(texts):
            between, out[i] = self.parts(text)
            for part in between:
                for piece in pieces(part):
                    held.append((i, PRE_TOKENS.findall(piece)))
                    size += len(piece)
                    if size >= PIECE:
                        settle()
                        size = 0
        settle()
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` by the vocabulary file at ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(Merges.load(path).plain())

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(Merges(*shared.value))
        for texts in batches:
            yield pd.Series(counter.tokens(texts.tolist()), dtype="int64")

    text = F.coalesce(docs["text"], F.lit(""))
    counted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
