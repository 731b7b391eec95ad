"""SentencePiece encoding and decoding with N-best segmentation.

The lattice over a text has an edge for every piece of the vocabulary at every place. A forward Viterbi
pass gives the best score up to each place; a backward A* search from the end uses these scores as its
heuristic. Since they are exact, paths come out best first, a path's best continuation needs no agenda,
and of all deviations from it the agenda holds only as many as segmentations are still asked for.

Between two characters that stand side by side in no piece, every path of the lattice has a node, so the
lattice is searched segment by segment; segments recur, and each is searched once while it is
remembered. The N best segmentations of a whole text are merged exactly from those of its segments.

Pieces match the text with a blank for the white-space mark, so a mark in the text itself is a foreign
character. Foreign characters fall back to byte pieces. Decoding gives back every text exactly.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from array import array
from bisect import insort
from collections.abc import Iterable
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame

from seamline.llm.texts import map_texts, worker_memory

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BEST = 3
#: Units of one generation of a worker's memory (it holds two), some 350 bytes each. The query, whose
#: workers hold nothing else, remembers more than a stage of a longer job should.
KNOWN_UNITS = 50_000
QUERY_UNITS = 800_000
KNOWN_LENGTH = 64
SPELT_UNITS = 20_000
#: How much less likely than the least piece each byte of a foreign character is.
FOREIGN_PENALTY = 10.0


class Model:
    """Pieces, ids and scores of a model file.

    ``scores``: "stored" takes those of the file, which must be log probabilities; "rank" is for files
    that store merge ranks instead, and takes Zipf's law over the pieces in order of id.
    """

    def __init__(self, path: str, scores: str = "rank"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.get_piece_size()
        special = {i for i in range(size) if processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i)}
        self.surface: list[bytes] = [b""] * size
        self.byte = [-1] * 256
        self.ids: dict[str, int] = {}
        zipf = -float(np.log((1.0 / np.arange(1, size + 1)).sum()))
        self.score = [0.0] * size
        for i in range(size):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte[value], self.surface[i] = i, bytes([value])
            elif i not in special:
                text = piece.replace(MARK, " ")
                self.surface[i] = text.encode()
                self.ids.setdefault(text, i)
                self.score[i] = processor.get_score(i) if scores == "stored" else zipf - float(np.log(i + 1))
        least = min(self.score[i] for i in self.ids.values())
        for i in self.byte:
            if i >= 0:
                self.score[i] = least - FOREIGN_PENALTY
        if min(self.byte) < 0:
            raise ValueError(f"{path} has no byte pieces")
        #: Trie nodes: children by character, and (score, ids) of the piece that ends at the node, if any.
        self.trie: tuple = ({}, None)
        for text, i in self.ids.items():
            node = self.trie
            for k, c in enumerate(text):
                last = k == len(text) - 1
                child = node[0].get(c) or ({}, None)
                node[0][c] = (child[0], (self.score[i], (i,))) if last else child
                node = node[0][c]
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(a != " " and b == " " or "\n" in (a, b) for a, b in self.neighbours):
            raise ValueError(f"{path} has pieces across words or lines")
        letter = re.compile(r"[^\W\d_]")
        mixed = {c for pair in self.neighbours if pair[0] != " " and bool(letter.match(pair[0])) != bool(letter.match(pair[1])) for c in pair if letter.match(c)}
        letters = rf"[^\W\d_{re.escape(''.join(sorted(mixed)))}]"
        #: Runs of letters and runs of other characters, blanks before them included: no piece crosses these.
        self.units = re.compile(rf" *(?:{letters}+|(?:(?!{letters})[^ \n])+)| +|\n")

    def segments(self, unit: str) -> list[str]:
        """The unit cut wherever no piece crosses."""
        near = self.neighbours
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in near]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def edges(self, segment: str) -> tuple[list[list], list[float]]:
        """For each end, edges (score of the best path over it, start, score, ids); and the best scores by end."""
        n, children = len(segment), self.trie[0]
        into: list[list] = [[] for _ in range(n + 1)]
        best = [0.0] + [-1e300] * n
        for a in range(n):
            upto = best[a]
            level, b, single = children, a, False
            for c in segment[a:]:
                node = level.get(c)
                if node is None:
                    break
                b += 1
                level, piece = node
                if piece is not None:
                    if b == a + 1:
                        single = True
                    over = upto + piece[0]
                    into[b].append((over, a, piece[0], piece[1]))
                    if over > best[b]:
                        best[b] = over
            if not single:
                raw = tuple([self.byte[x] for x in segment[a].encode("utf-8", "surrogatepass")])
                score = sum([self.score[i] for i in raw])
                into[a + 1].append((upto + score, a, score, raw))
                best[a + 1] = max(best[a + 1], upto + score)
        return into, best

    def n_best(self, segment: str, count: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``count`` best segmentations, best first, ties in a fixed order."""
        into, best = self.edges(segment)
        found, order = [], 0
        agenda = [(-best[-1], 0, len(segment), 0.0, ())]
        wanted = count
        while agenda and wanted:
            wanted -= 1
            _, _, at, behind, path = agenda.pop(0)
            while at:
                options, top, chosen = into[at], best[at], None
                for e in options:
                    if chosen is None and e[0] == top:
                        chosen = e
                    elif wanted:
                        loss = -(behind + e[0])
                        if len(agenda) < wanted or loss < agenda[-1][0]:
                            order += 1
                            insort(agenda, (loss, order, e[1], behind + e[2], (e[3], path)))
                            del agenda[wanted:]
                _, at, score, ids = chosen
                behind += score
                path = (ids, path)
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((behind, tuple(ids)))
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, less the blank that encoding puts first."""
        return self.text_of(map(self.surface.__getitem__, ids))

    @staticmethod
    def text_of(surfaces: Iterable[bytes]) -> str:
        return b"".join(surfaces)[1:].decode("utf-8", "surrogatepass")


def least_losses(options: list[tuple[float, ...]], count: int) -> list[float]:
    """The ``count`` least sums of one choice each, where choosing the best costs nothing.

    Each of ``options`` lists the losses of what follows the best, ascending; only the ``count`` - 1 lists
    that begin lowest can take part.
    """
    if len(options) > 1:
        options = heapq.nsmallest(count - 1, options)
    elif len(options) == 1:
        return [0.0, *options[0]][:count]
    sums = [0.0]
    for losses in options:
        sums = heapq.nsmallest(count, [a + b for a in sums for b in (0.0, *losses)])
    return sums


class Memory(dict):
    """A mapping computed on demand that keeps what was used in its last two generations."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.former, self.size = compute, {}, size

    def __missing__(self, key: str):
        value = self.former.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= KNOWN_LENGTH:
            if len(self) >= self.size:
                self.former = dict(self)
                self.clear()
            self[key] = value
        return value


class Units:
    """Segmentations of the units of texts: (ids, score of the best, losses of the following)."""

    def __init__(self, model: Model, count: int, size: int = KNOWN_UNITS):
        self.model, self.count = model, count
        self.known = Memory(self.search, size)
        #: Of the units in which some text's later segmentations deviate.
        self.spelt = Memory(self.spellings, min(size, SPELT_UNITS))

    def search(self, unit: str) -> tuple[tuple[int, ...], float, tuple[float, ...]]:
        ids: list[int] = []
        total, options = 0.0, []
        for segment in self.model.segments(unit):
            found = self.model.n_best(segment, self.count)
            score, best = found[0]
            ids += best
            total += score
            if len(found) > 1:
                options.append(tuple([score - s for s, _ in found[1:]]))
        return tuple(ids), total, tuple(least_losses(options, self.count)[1:])

    def spellings(self, unit: str) -> list[tuple[int, ...]]:
        """Ids of the best segmentations of a unit; the losses of ``search`` are those of its later ones, in order."""
        ways: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for segment in self.model.segments(unit):
            found = self.model.n_best(segment, self.count)
            ways = heapq.nsmallest(self.count, [(loss + found[0][0] - s, ids + more) for loss, ids in ways for s, more in found], key=itemgetter(0))
        return [ids for _, ids in ways]

    def encode(self, text: str) -> tuple[list[int], list[float]]:
        """Ids of the best segmentation and the scores of the best ones of the whole text."""
        ids, scores, _ = self.search_text(text)
        return ids, scores

    def search_text(self, text: str) -> tuple[list[int], list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Ids of the best segmentation, scores, and by segmentation in what it deviates from the best.

        Deviations are (start, end, ids to put for those from start to end), in order.
        """
        if not text:
            return [], [0.0], [[]]
        names = self.model.units.findall(" " + text)
        found = list(map(self.known.__getitem__, names))
        ids: list[int] = []
        for unit in found:
            ids += unit[0]
        score = sum([unit[1] for unit in found])
        every = [unit[2] for unit in found]
        options: list[tuple[tuple[float, ...], int]] = []
        for losses in heapq.nsmallest(self.count - 1, filter(None, every)):
            tied = options and options[-1][0] == losses
            options.append((losses, every.index(losses, options[-1][1] + 1 if tied else 0)))
        ways: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for losses, k in options:
            more = [(a + b, chosen + ((k, j),)) for a, chosen in ways for j, b in enumerate(losses, 1)]
            ways = heapq.nsmallest(self.count, ways + more, key=itemgetter(0))
        starts: dict[int, int] = {}
        at, last = 0, 0
        for k in sorted({k for _, chosen in ways for k, _ in chosen}):
            at += sum([len(unit[0]) for unit in found[last:k]])
            starts[k], last = at, k
        changes = [[(starts[k], starts[k] + len(found[k][0]), self.spelt[names[k]][j]) for k, j in sorted(chosen)] for _, chosen in ways]
        return ids, [score - loss for loss, _ in ways], changes

    def n_best(self, text: str) -> tuple[list[list[int]], list[float]]:
        """Ids and scores of the best segmentations of the whole text, best first."""
        ids, scores, changes = self.search_text(text)
        return [with_changes(ids, c) for c in changes], scores


def with_changes(ids, changes: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    out, last = [], 0
    for start, end, put in changes:
        out += ids[last:start]
        out += put
        last = end
    return out + ids[last:]


def units_of(path: str, scores: str, count: int, size: int) -> Units:
    """The units that this worker has met with the model, in tasks before too."""
    gc.disable()  # their memory has no cycles, and is slow to walk
    return worker_memory(("pieces", path, scores, count, size), lambda: Units(Model(path, scores), count, size))


def encode(df: DataFrame, text: str, keep: list[str], model: str = DEFAULT_MODEL, best: int = BEST, scores: str = "rank", known: int = KNOWN_UNITS) -> DataFrame:
    """``keep`` with ``piece_ids`` of the best segmentation, ``n_best_scores``, best first, and ``next_ids``.

    ``next_ids`` lists the ids of the second best segmentation and so on, in the order of the scores. Null and
    empty texts have no pieces and one segmentation of score 0. The model file must be at the same path on
    every executor.
    """

    def make():
        units = units_of(model, scores, best, known)

        def of(t: bytes | None):
            found, values = units.n_best((t or b"").decode("utf-8", "surrogatepass"))
            return found[0], values, found[1:]

        return of

    return map_texts(df, text, "piece_ids array<int>, n_best_scores array<double>, next_ids array<array<int>>", make, keep)


def tokenised(df: DataFrame, text: str, keep: list[str], model: str = DEFAULT_MODEL, best: int = BEST, scores: str = "rank", known: int = KNOWN_UNITS) -> DataFrame:
    """``keep`` with digests of the encoding, whose segmentations are all decoded again.

    n_pieces, n_byte_pieces, best_score, next_score (of the second best; null if there is none), ids_sha256
    (little-endian 32-bit ids), exact (decoding gave the text back, from every segmentation); n_best_scores
    and n_best_sha256 of all segmentations, best first. Null and empty texts have one empty segmentation; texts of any
    length are searched whole; equal scores go by ids; repeated rows are searched each; an empty table gives no rows;
    columns of ``keep`` with the name of a result are replaced by it.
    """
    fields = (
        "n_pieces bigint, n_byte_pieces bigint, best_score double, next_score double, ids_sha256 string, exact boolean, "
        "n_best_scores array<double>, n_best_sha256 array<string>"
    )

    def make():
        units = units_of(model, scores, best, known)
        first, last_byte = min(units.model.byte), max(units.model.byte)

        def of(t: bytes | None):
            text = (t or b"").decode("utf-8", "surrogatepass")
            ids, values, changes = units.search_text(text)
            best_ids, surface = np.array(array("i", ids), "<i4"), units.model.surface
            parts = list(map(surface.__getitem__, ids))
            digests, exact = [], True
            for change in changes:
                as_array, as_bytes, last = [], [], 0
                for start, end, put in change:
                    as_array += best_ids[last:start], np.array(put, "<i4")
                    as_bytes += parts[last:start]
                    as_bytes += map(surface.__getitem__, put)
                    last = end
                whole = np.concatenate((*as_array, best_ids[last:])) if change else best_ids
                digests.append(hashlib.sha256(whole.tobytes()).hexdigest())
                exact = exact and Model.text_of(as_bytes + parts[last:]) == text
            raw = int(((best_ids >= first) & (best_ids <= last_byte)).sum())
            following = values[1] if len(values) > 1 else None
            return len(ids), raw, values[0], following, digests[0], exact, values, digests

        return of

    return map_texts(df, text, fields, make, keep)


def op3_piece_nbest(spark, sf_dir: str) -> DataFrame:
    """Every document encoded to its three best segmentations, each with score and digest, and decoded again."""
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"], known=QUERY_UNITS)
