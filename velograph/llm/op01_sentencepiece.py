"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

All segmentations of a text into pieces of the vocabulary form a lattice. Backward sums give each edge its
probability given where it starts, so a path's perturbed log probability (log probability plus Gumbel
noise) can be drawn from the top down: the best path takes the noise of the whole, and the edges passed
over at each place hold, as one node, a draw cut off by their parent's. A-star search takes the largest
open node, picks one of its edges, completes it to a path and puts what that passes over back as new
nodes; so paths come in the order of their perturbed values, distinct, k of them. The largest node left
open is the threshold: with it, a sample's inclusion score is log(1 - exp(-exp(log_prob - threshold))),
and 0 where the lattice has no more paths.

The noise is a hash of the row key, the sample and the place, so a row gives the same samples wherever it
is read, with the same scores in every bit. Pieces don't reach across a word's start, so the lattice is built once for each distinct word of
a batch and shared by its occurrences, in numpy; a long text is one more text, and a task holds
`slice_bytes` of text (one text at least) at a time.

Piece scores of a unigram model are log probabilities; those of a BPE model are ranks, which are taken as
Zipf weights. Characters out of the vocabulary are spelled in byte pieces. A null or empty text has one
segmentation, the empty one. U+2581 in a text is spelled in bytes too, so decoding gives the exact text.
A null doc_id has a key like any other. Repeated rows give repeated, equal samples, and texts of one id share their
noise. Equal open nodes are taken in order of path and place. A text longer than `slice_bytes` is a slice of its own. An empty
table gives none. Bytes that are no UTF-8 are read as U+FFFD, and the round trip is of what was read. Other columns of
the table, whatever their names, aren't read.
"""

from __future__ import annotations

import os
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common

SPACE = "▁"
_LITERAL = "\udfff"  # stands for U+2581 that was in the text; no text holds it
SCHEMA = "doc_id bigint, sample_no int, n_tokens bigint, log_prob double, log_inclusion double, round_trip boolean, ids array<int>"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Sampling:
    k: int = 2
    alpha: float = 0.3
    seed: int = 1
    slice_bytes: int = 1 << 20


class Lexicon:
    """Pieces as a trie in two hash tables of which each key is in one; and their weights and bytes."""

    def __init__(self, proto: bytes, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        self.bytes_of: list[bytes] = []
        scores, usable = np.zeros(n), []
        for i in range(n):
            piece = sp.id_to_piece(i)
            scores[i] = sp.get_score(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                if SPACE not in piece.lstrip(SPACE):
                    usable.append((piece, i))
        ranked = all(scores[i] == round(scores[i]) for _, i in usable)
        weight = -np.log(2 - scores) if ranked else scores.copy()
        keep = [i for _, i in usable]
        weight = weight - np.log(np.exp(weight[keep]).sum())
        # After the pieces come four more: a character spelled in one to four bytes.
        self.n = n
        self.weight = alpha * np.concatenate([weight, (weight[keep].min() - 1) * np.arange(1, 5)])
        self.share = np.exp(self.weight)
        nodes: dict[tuple[int, int], int] = {}
        self.piece_at = [-1]
        for piece, i in usable:
            at = 0
            for c in piece:
                nxt = nodes.get((at, ord(c)))
                if nxt is None:
                    nxt = nodes[at, ord(c)] = len(self.piece_at)
                    self.piece_at.append(-1)
                at = nxt
            self.piece_at[at] = i
        self.piece_at = np.array(self.piece_at, np.int32)
        self.first = np.zeros(0x110000, np.int32)
        rest = {}
        for (at, c), nxt in nodes.items():
            if at:
                rest[at << 21 | c] = nxt
            else:
                self.first[c] = nxt
        self._hash(rest)
        lens = np.array([len(b) for b in self.bytes_of])
        self.byte_len, self.byte_at = lens, np.cumsum(lens) - lens
        self.byte_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _hash(self, rest: dict[int, int]) -> None:
        self.bits = max(4, int(len(rest) * 2.2).bit_length())
        size = 1 << self.bits
        keys, values = [[-1] * size, [-1] * size], [[0] * size, [0] * size]
        for key, value in rest.items():
            side = 0
            for _ in range(500):
                slot = key * _ODD[side] % (1 << 64) >> (64 - self.bits)
                key, keys[side][slot] = keys[side][slot], key
                value, values[side][slot] = values[side][slot], value
                if key < 0:
                    break
                side = 1 - side
            else:
                raise ValueError("the trie's tables are too small")
        self.keys, self.values = np.array(keys, np.int64), np.array(values, np.int32)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 21 | char
        out = np.zeros(len(key), np.int32)
        for side in (0, 1):
            slot = (key.view(np.uint64) * np.uint64(_ODD[side]) >> np.uint64(64 - self.bits)).view(np.int64)
            hit = self.keys[side][slot] == key
            out[hit] = self.values[side][slot[hit]]
        return out

    def decode(self, flat: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, together, and how many each has."""
        n = self.byte_len[flat]
        return self.byte_flat[ragged(self.byte_at[flat], n)].tobytes(), n


_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then those of start[1], and so on."""
    total = int(size.sum())
    kind = np.int32 if total < 1 << 30 and (not len(start) or start.max() < 1 << 30) else np.int64
    out = np.repeat((start - (np.cumsum(size) - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


#: Up to so many characters from a unit's end, sums are of probabilities; beyond, of their logs.
_PLAIN = 24


class Lattice:
    """Of units, by place. What can follow a place depends on the rest of its unit alone, so units that end alike
    share their places: place 0 is every unit's end, then come the distinct last characters, the distinct last two, and
    so on. The edges of a place lie together, the longest first: piece, target, running probability, log
    probability, and the log of what the place's other edges hold."""

    def __init__(self, units: list[str], lex: Lexicon):
        sizes = np.array([len(u) for u in units], np.int64)
        order = np.argsort(-sizes, kind="stable")
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends, sizes = np.cumsum(sizes)[order], sizes[order]
        deepest = int(sizes.max(initial=0))
        width = np.searchsorted(-sizes, -np.arange(deepest + 2), side="right").tolist()
        start, at_unit = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        self.points, parent = np.zeros(len(points) + 1, np.int32), np.zeros(len(points) + 1, np.int32)
        back, held_at = np.ones(len(points) + 1), np.zeros(len(points) + 1, np.int16)
        froms, slots, pieces, targets = [], [], [], []
        here = 1
        for d in range(1, deepest + 1):
            if d == _PLAIN + 1:
                back[:here] = np.log(back[:here])
            w = width[d]
            code, kinds = pd.factorize(at_unit[:w] << 21 | points[ends[:w] - d])
            at_unit[:w] = code + here
            start[width[d + 1] : w] = at_unit[width[d + 1] : w]
            layer = slice(here, here + len(kinds))
            self.points[layer], parent[layer] = kinds & 0x1FFFFF, kinds >> 21
            total = np.zeros(len(kinds)) if d <= _PLAIN else np.full(len(kinds), -np.inf)
            own = held_at[layer]
            who, pos = np.arange(len(kinds), dtype=np.int32), parent[layer]
            node = lex.first[self.points[layer]]
            for length in range(1, d + 1):
                piece = lex.piece_at[node]
                if length == 1:
                    odd = np.flatnonzero(piece < 0)
                    if len(odd):
                        c = self.points[here + odd]
                        piece[odd] = lex.n + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    at, piece, target = who[hit], piece[hit], pos[hit]
                    if d <= _PLAIN:
                        total[at] += lex.share[piece] * back[target]
                    else:
                        total[at] = np.logaddexp(total[at], lex.weight[piece] + back[target])
                    froms.append(at + here)
                    slots.append(own[at])
                    pieces.append(piece)
                    targets.append(target)
                    own[at] += 1
                if length == d:
                    break
                go = np.flatnonzero(node)
                who, pos, node = who[go], pos[go], node[go]
                node = lex.step(node, self.points[pos])
                go = np.flatnonzero(node)
                who, pos, node = who[go], parent[pos[go]], node[go]
                if not len(who):
                    break
            back[layer] = total
            here += len(kinds)
        self.start = np.empty(len(units), np.int64)
        self.start[order] = start
        back, held_at = back[:here], held_at[:here]
        if deepest <= _PLAIN:
            back = np.log(back)
        self.first = np.concatenate([[0], np.cumsum(held_at)]).astype(np.int32)
        if not froms:
            froms, slots, pieces, targets = ([np.zeros(0, np.int32)] for _ in range(4))
        begin, piece, target = (np.concatenate(x) for x in (froms, pieces, targets))
        at = self.first[begin + 1] - 1 - np.concatenate(slots)
        self.piece, self.to, self.cond = (np.empty(len(at), k) for k in (np.int32, np.int32, np.float64))
        self.piece[at], self.to[at], self.cond[at] = piece, target, lex.weight[piece] + back[target] - back[begin]
        share = np.exp(self.cond)
        starts = self.first[1:-1]
        held = np.diff(self.first)[1:]
        # Added up place by place, so that rounding doesn't depend on what else is in the batch.
        run = share.copy()
        for k in range(1, int(held.max(initial=0))):
            more = starts[held > k] + k
            run[more] += run[more - 1]
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(np.repeat(np.add.reduceat(share, starts), held) - share, 0)) if len(starts) else np.zeros(0)
        # An edge that holds nearly all leaves a difference too rough: there the others are added up.
        rough = np.flatnonzero(share > 0.999)
        if len(rough):
            owner = np.searchsorted(self.first, rough, side="right") - 1
            others = ragged(self.first[owner], np.diff(self.first)[owner])
            group = np.repeat(np.arange(len(rough)), np.diff(self.first)[owner])
            sums = np.bincount(group, weights=np.where(others == rough[group], 0.0, share[others]), minlength=len(rough))
            with np.errstate(divide="ignore"):
                rest[rough] = np.log(sums)
        self.rest = rest
        if len(starts):
            run[self.first[2:] - 1] = np.inf  # the last edge takes what rounding leaves
        self.run = run.astype(np.float32)

    def edges(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place: its edges, side by side, and which of those columns it has."""
        size = self.first[place + 1] - self.first[place]
        columns = np.arange(int(size.max(initial=1)))
        has = columns < size[:, None]
        return np.where(has, self.first[place][:, None] + columns, 0), has

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each place."""
        edge = self.first[place]
        todo = np.flatnonzero(self.run[edge] < u)
        while len(todo):
            edge[todo] += 1
            todo = todo[self.run[edge[todo]] < u[todo]]
        return edge


def mixed(key: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash for each row, of the key and whatever else."""
    x = key.astype(np.uint64)
    for m in more:
        x = (x ^ np.asarray(m).astype(np.uint64)) * np.uint64(_ODD[0])
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def uniform(key: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    """A number in (0, 1) for each row, from such a hash."""
    x = mixed(key, *more)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def cut_gumbel(mu: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel draw around mu, given that it is under the bound; -inf where mu is."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = mu - np.log(np.exp(mu - bound) - np.log(u))
    return np.where(mu == -np.inf, -np.inf, np.minimum(out, bound))


class _Paths:
    """A path for each of some documents, their tokens in a row. own: those tokens whose nodes came with this path,
    the others are an earlier path's; prefix and open (the draw of the node) are of these alone."""

    def __init__(self, docs, edge, occ, offset, own, own_offset, prefix, opened):
        self.docs, self.edge, self.occ, self.offset = docs, edge, occ, offset
        self.own, self.own_offset, self.prefix, self.open = own, own_offset, prefix, opened
        self.taken: dict[int, list[int]] = {}

    def best(self, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """By document: the largest open node and its place in own; -inf and -1 without any."""
        value, token = np.full(n_docs, -np.inf), np.full(n_docs, -1)
        size = np.diff(self.own_offset)
        has = size > 0
        if has.any():
            top = np.maximum.reduceat(self.open, self.own_offset[:-1][has])
            hits = np.flatnonzero(self.open == np.repeat(top, size[has]))
            owner = np.repeat(np.flatnonzero(has), size[has])[hits]
            row, first = np.unique(owner, return_index=True)
            value[self.docs[has]] = top
            token[self.docs[row]] = hits[first]
        return value, token


def _walk(lat: Lattice, place: np.ndarray, key: np.ndarray, *more) -> tuple[np.ndarray, np.ndarray]:
    """From each place to its unit's end: which of the places a token is of, and its edge, in order."""
    whos, edges, n = [], [], np.zeros(len(place), np.int64)
    who = np.flatnonzero(place)
    at, hashed = place[who], mixed(key[who], *[m[who] if isinstance(m, np.ndarray) else m for m in more])
    while len(who):
        edge = lat.draw(at, (mixed(hashed, len(whos)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24))
        whos.append(who)
        edges.append(edge)
        n[who] += 1
        at = lat.to[edge]
        go = np.flatnonzero(at)
        who, at, hashed = who[go], at[go], hashed[go]
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int32)
    for s, (w, e) in enumerate(zip(whos, edges, strict=True)):
        out[first[w] + s] = e
    return np.repeat(np.arange(len(place)), n), out


def sample(lat: Lattice, units: np.ndarray, offset: np.ndarray, keys: np.ndarray, k: int) -> tuple[list[dict], np.ndarray]:
    """k samples at most for each document: units[offset[d]:offset[d+1]] are its units, in order. A sample
    has docs, offset, edge, log_prob, perturbed; also the threshold, by document."""
    n_docs = len(offset) - 1
    unit_doc = np.repeat(np.arange(n_docs), np.diff(offset))
    number = np.arange(len(units)) - offset[:-1][unit_doc]
    begin = lat.start[units]
    root = -np.log(-np.log(uniform(keys, 0, 1)))
    paths: list[_Paths] = []
    out: list[dict] = []

    def settle(docs, edge, occ, owned_from, before, bound):
        """Puts back what a path passes over from its token owned_from on; before: the log probability up to there."""
        number_of = len(paths)
        sizes = np.bincount(unit_doc[occ], minlength=n_docs)[docs] if len(docs) else np.zeros(0, np.int64)
        off = np.concatenate([[0], np.cumsum(sizes)])
        own = ragged(off[:-1] + owned_from, sizes - owned_from)
        own_off = np.concatenate([[0], np.cumsum(sizes - owned_from)])
        own_edge = edge[own]
        # Added up document by document, so that scores are the same in every bit whatever the batch.
        cond = lat.cond[own_edge]
        prefix, log_prob = np.empty(len(own)), before.astype(np.float64)
        for d, (a, b) in enumerate(zip(own_off[:-1].tolist(), own_off[1:].tolist(), strict=True)):
            if b > a:
                run = np.cumsum(np.concatenate([before[d : d + 1], cond[a:b]]))
                prefix[a:b], log_prob[d] = run[:-1], run[-1]
        rest = lat.rest[own_edge]
        live = np.flatnonzero(rest > -np.inf)
        row = np.repeat(np.arange(len(docs)), np.diff(own_off))[live]
        opened = np.full(len(own), -np.inf)
        opened[live] = cut_gumbel(prefix[live] + rest[live], bound[row], uniform(keys[docs[row]], 7 + number_of, own[live] - off[row]))
        paths.append(_Paths(docs, edge, occ, off, own, own_off, prefix, opened))
        out.append({"docs": docs, "offset": off, "edge": edge, "log_prob": log_prob, "perturbed": bound})

    who, edge = _walk(lat, begin, keys[unit_doc], 3, number)
    settle(np.arange(n_docs), edge, who, np.zeros(n_docs, np.int64), np.zeros(n_docs), root)
    while True:
        tops = [p.best(n_docs) for p in paths]
        values = np.stack([v for v, _ in tops])
        which = values.argmax(axis=0)
        best = values[which, np.arange(n_docs)]
        docs = np.flatnonzero(best > -np.inf)
        if len(paths) == k or not len(docs):
            return out, best
        j = len(paths)
        kept_n, kept_from = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        node_edge, node_occ, before_node = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), np.zeros(len(docs))
        base = np.cumsum([0, *[len(p.edge) for p in paths]])
        for i, p in enumerate(paths):
            mine = np.flatnonzero(which[docs] == i)
            if not len(mine):
                continue
            node = tops[i][1][docs[mine]]
            token = p.own[node]
            row = np.searchsorted(p.docs, docs[mine])
            kept_from[mine], kept_n[mine] = base[i] + p.offset[row], token - p.offset[row]
            choices, has = lat.edges(_place_of(lat, p.edge[token]))
            free = np.where(has, np.exp(lat.cond[choices]), 0.0)
            for x, t in enumerate(token.tolist()):
                gone = p.taken.setdefault(t, [int(p.edge[t])])
                free[x, np.isin(choices[x], gone)] = 0
            run = np.cumsum(free, axis=1)
            u = uniform(keys[docs[mine]], 5, j) * run[:, -1]
            column = np.minimum((run <= u[:, None]).sum(axis=1), free.shape[1] - 1)
            chosen = choices[np.arange(len(mine)), column]
            node_edge[mine], node_occ[mine], before_node[mine] = chosen, p.occ[token], p.prefix[node]
            free[np.arange(len(mine)), column] = 0
            for t, e in zip(token.tolist(), chosen.tolist(), strict=True):
                p.taken[t].append(e)
            with np.errstate(divide="ignore"):
                mu = p.prefix[node] + np.log(np.cumsum(free, axis=1)[:, -1])
            p.open[node] = cut_gumbel(mu, best[docs[mine]], uniform(keys[docs[mine]], 11, j))
        # The tokens before the node, the chosen edge, the rest of its unit, the units after.
        later = ragged(node_occ + 1, offset[docs + 1] - node_occ - 1)
        occ = np.concatenate([node_occ, later])
        who, walked = _walk(lat, np.concatenate([lat.to[node_edge], begin[later]]), keys[unit_doc[occ]], 100 + j, number[occ])
        before = ragged(kept_from, kept_n)
        pool_edge, pool_occ = (np.concatenate([getattr(p, a) for p in paths]) for a in ("edge", "occ"))
        all_edge = np.concatenate([pool_edge[before], node_edge, walked])
        all_occ = np.concatenate([pool_occ[before], node_occ, occ[who]])
        order = np.argsort(all_occ, kind="stable")  # one unit's tokens stand in order already
        settle(docs, all_edge[order], all_occ[order], kept_n + 1, before_node + lat.cond[node_edge], best[docs])


def _place_of(lat: Lattice, edge: np.ndarray) -> np.ndarray:
    return np.searchsorted(lat.first, edge, side="right") - 1


def _names() -> dict[str, int]:
    """Numbers what it is asked for, from 0 on."""
    return defaultdict(count().__next__)


def units_of(texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units; the units of all texts in order, as numbers; where each text's begin and end. A unit is
    a word with the spaces before it, or a line end. The first word has one space more than the text."""
    spaced, bare = _names(), _names()  # spaced: less its one leading space
    which, sizes = [], []
    for text in texts:
        row: list[int] = []
        if text:
            s = text.decode("utf-8", "replace")
            if SPACE in s:
                s = s.replace(SPACE, _LITERAL)
            for n, line in enumerate(s.split("\n")):
                words = line.split(" ")
                if n:
                    row.append(~bare["\n"])
                    if words[0]:
                        row.append(~bare[words[0]])
                    words = words[1:]
                if "" in words:
                    spaces = 1
                    for w in words:
                        if w == "":
                            spaces += 1
                        else:
                            row.append(~bare[SPACE * spaces + w])
                            spaces = 1
                    if spaces > 1:
                        row.append(~bare[SPACE * (spaces - 1)])
                else:
                    row.extend(map(spaced.__getitem__, words))
        which.append(np.array(row, np.int64))
        sizes.append(len(row))
    flat = np.concatenate(which) if which else np.zeros(0, np.int64)
    flat = np.where(flat < 0, len(spaced) + ~flat, flat)
    return [SPACE + w for w in spaced] + list(bare), flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ids(lat: Lattice, lex: Lexicon, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Ids of tokens, spelled ones as their bytes; and how many ids each token has, None if one each."""
    ids = lat.piece[edge]
    odd = np.flatnonzero(ids >= lex.n)
    if not len(odd):
        return ids, None
    chars, back = np.unique(lat.points[_place_of(lat, edge[odd])], return_inverse=True)
    spelled = [(SPACE if c == ord(_LITERAL) else chr(c)).encode() for c in chars.tolist()]
    n_bytes = np.array([len(b) for b in spelled])[back]
    flat = np.frombuffer(b"".join(spelled), np.uint8)
    first = np.cumsum([0, *[len(b) for b in spelled]])
    n = np.ones(len(ids), np.int64)
    n[odd] = n_bytes
    out = np.repeat(ids, n)
    out[ragged((np.cumsum(n) - n)[odd], n_bytes)] = lex.byte_ids[flat[ragged(first[back], n_bytes)]]
    return out, n


def encode_batch(texts: list[bytes | None], keys: np.ndarray, lex: Lexicon, how: Sampling) -> dict[str, np.ndarray]:
    """Columns of the samples of a batch; row: the place of the text."""
    units, flat, offset = units_of(texts)
    lat = Lattice(units, lex)
    samples, threshold = sample(lat, flat, offset, keys, how.k)
    rows, numbers, logs, scores, counts, ids, trips = [], [], [], [], [], [], []
    for j, s in enumerate(samples):
        own, n = _ids(lat, lex, s["edge"])
        run = s["offset"] if n is None else np.concatenate([[0], np.cumsum(n)])[s["offset"]]
        packed, n_bytes = lex.decode(own)
        d_run = np.concatenate([[0], np.cumsum(n_bytes)])[run].tolist()
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            gap = s["log_prob"] - threshold[s["docs"]]
            score = np.where(threshold[s["docs"]] == -np.inf, 0.0, np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700))))))
        rows.append(s["docs"])
        numbers.append(np.full(len(s["docs"]), j + 1, np.int32))
        logs.append(s["log_prob"] + 0.0)
        scores.append(score + 0.0)
        counts.append(np.diff(run))
        ids.append(own)
        trips += [packed[a + 1 : b] == (texts[d] or b"") or packed[a + 1 : b] == (texts[d] or b"").decode("utf-8", "replace").encode() for d, a, b in zip(s["docs"].tolist(), d_run, d_run[1:], strict=False)]
    return {"row": np.concatenate(rows), "sample_no": np.concatenate(numbers), "log_prob": np.concatenate(logs), "log_inclusion": np.concatenate(scores), "n_tokens": np.concatenate(counts), "ids": np.concatenate(ids), "round_trip": np.array(trips, bool)}


def _row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    return np.array([0 if i is None else (2 * i + 1) % (1 << 64) for i in ids.to_pylist()], np.uint64) * np.uint64(_ODD[1]) ^ np.uint64(seed)


def load(path: str | None = None, how: Sampling = Sampling()) -> Lexicon:
    with open(path or os.environ.get("SENTENCEPIECE_MODEL") or model_path(), "rb") as f:
        return Lexicon(f.read(), how.alpha)


def encode(docs: DataFrame, how: Sampling = Sampling(), path: str | None = None) -> DataFrame:
    """k samples at most for each row of docs (doc_id, text), in the columns of SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path, how))  # of the vocabulary, whatever the corpus

    def run(batches):
        lex = shared.value
        for batch in batches:
            for rows in common.parts(batch, 1, how.slice_bytes):
                part = rows.column(0)
                x = encode_batch(common.byte_texts(rows.column(1)), _row_keys(part, how.seed), lex, how)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(x["n_tokens"])]), pa.int32()), pa.array(x["ids"], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.take(pa.array(x["row"])), pa.array(x["sample_no"], pa.int32()), pa.array(x["n_tokens"], pa.int64()), pa.array(x["log_prob"]), pa.array(x["log_inclusion"]), pa.array(x["round_trip"]), lists],
                    ["doc_id", "sample_no", "n_tokens", "log_prob", "log_inclusion", "round_trip", "ids"],
                )

    return common.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA)


def decode(encoded: DataFrame, column: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with a column `decoded`: the exact text of the ids; null ids give null."""
    common.ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(path).bytes_of)

    def run(batches):
        for batch in batches:
            yield pa.array([None if x is None else b"".join(map(shared.value.__getitem__, x))[1:].decode("utf-8", "replace") for x in batch.to_pylist()], pa.string())

    run.__annotations__ = common.ARRAY_ITERATOR
    return encoded.withColumn("decoded", F.arrow_udf(run, "string")(F.col(column)))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
