"""Byte-level BPE as a deterministic token automaton.

Merge gadgets. The token automaton starts as one state with an arc per byte. The merges
are applied in rank order; the gadget of merge (u, v) -> w takes the arc v away from
every state reached by reading u and adds the arc w beside it, into the state that v
led to. After the last gadget a state is known by the arc that was read last, and a
path spells a text's canonical encoding and no other. Written out, the arcs are states
times vocabulary (about two thousand million for 50,000 merges); instead the gadgets
are kept in tables (halves, rank of every pair), and whether the arc b leaves state a is
read off them by undoing gadgets latest first.

Byte automaton. Words are read by bytes, so the token automaton is determinised over
them: a state is the last token of the canonical encoding of what was read, and the
tokens that are being read, each as a node of the vocabulary's trie and the state that
it leaves. Exactly one arc ends after every byte. States and transitions are compiled
when they are first asked for, into a table by state and byte, and stay; when there are
more than ``MOST_STATES`` the table starts again from the states in use.

Encoding walks the table, all words of a batch at once, and reads the tokens backwards
from the words' last states. Decoding emits arc labels.
"""

from __future__ import annotations

import json

import numpy as np
import regex

#: The pre-split pattern of the byte-level vocabulary.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Transitions found at a time, and states and slots of the table.
BLOCK, MOST_STATES, SLOTS = 50_000, 400_000, 1 << 21
NEVER = np.int64(1) << 40


def byte_letters() -> dict:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BpeAutomaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        letters = byte_letters()
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size + 1  # the last number is no token: it marks the first state
        self.labels: list = [b""] * size
        for token, k in vocab.items():
            self.labels[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            self.labels[k] = token.encode()
        self.label_len = np.array([len(x) for x in self.labels], dtype=np.int64)
        self._apply_gadgets(vocab, merges)
        self._build_trie(vocab)
        self._start([])
        self.pattern = regex.compile(PRE_SPLIT)
        self.decimals = [str(k).encode() for k in range(size)]

    def _apply_gadgets(self, vocab: dict, merges: list) -> None:
        self.left = np.full(self.size, -1, dtype=np.int64)
        self.right = np.full(self.size, -1, dtype=np.int64)
        self.born = np.full(self.size, -1, dtype=np.int64)
        keys = np.empty(len(merges), dtype=np.int64)
        for rank, (u, v) in enumerate(merges):
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            if self.born[w] >= 0:
                raise ValueError(f"two merges make {u + v!r}")
            self.left[w], self.right[w], self.born[w] = a, b, rank
            keys[rank] = a * self.size + b
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        made = np.flatnonzero(self.born >= 0)
        self.reachable = np.zeros(self.size, dtype=bool)
        for token in vocab.values():
            self.reachable[token] = True
        # a token whose own bytes are encoded in another way has no arc
        self.reachable[made] = self._undo(self.left[made], self.right[made], self.born[made])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def _undo(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no gadget takes the arc b away from the state a.

        Both sides are undone, latest gadget first; a gadget whose halves meet at
        the border takes the arc away if it came before either half was absorbed
        (at the same rank, the place further left is merged first)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), dtype=bool)
        end_a = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        end_b = end_a.copy() if before is None else before.astype(np.int64) - 1
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self._rank(x, y)
            taken = (rank < end_a[live]) & (rank <= end_b[live]) & (rank != NEVER)
            good[live[taken]] = False
            bx, by = self.born[x], self.born[y]
            stay = ~taken & ((bx >= 0) | (by >= 0))
            live, x, y, bx, by = live[stay], x[stay], y[stay], bx[stay], by[stay]
            undo_b = by >= bx
            i = live[undo_b]
            end_b[i], b[i] = by[undo_b], self.left[y[undo_b]]
            i = live[~undo_b]
            end_a[i], a[i] = bx[~undo_b], self.right[x[~undo_b]]
        return good

    def _build_trie(self, vocab: dict) -> None:
        nodes, ends = [{}], {}
        for k in vocab.values():
            node = 0
            for byte in self.labels[k]:
                step = nodes[node]
                if byte not in step:
                    step[byte] = len(nodes)
                    nodes.append({})
                node = step[byte]
            if self.reachable[k]:
                ends[node] = k
        inner = [n for n, step in enumerate(nodes) if step]
        row_of = {n: i + 1 for i, n in enumerate(inner)}  # row 0 leads nowhere
        self.goto = np.full((len(inner) + 1, 256), -1, dtype=np.int32)
        for n in inner:
            for byte, to in nodes[n].items():
                self.goto[row_of[n], byte] = to
        self.row = np.array([row_of.get(n, 0) for n in range(len(nodes))], dtype=np.int32)
        self.end = np.full(len(nodes), -1, dtype=np.int32)
        self.end[list(ends)] = list(ends.values())
        self.root = 0

    def _start(self, kept: list) -> None:
        """An empty table with the first state and those of ``kept``: (last token, tokens
        being read). A token being read is its trie node times size plus the state left."""
        self.states: list = []
        self.number: dict = {}
        self.last = np.full(MOST_STATES + BLOCK + 1, -1, dtype=np.int32)
        self.keys = np.full(SLOTS, -1, dtype=np.int64)
        self.to = np.zeros(SLOTS, dtype=np.int32)
        self.held = 0
        for state in [(-1, ()), *kept]:
            self._state(state)

    def _state(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = n = len(self.states)
            self.states.append(state)
            self.last[n] = state[0]
        return self.number[state]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x9E3779B97F4A7C1 | 1) >> np.int64(25)) & np.int64(SLOTS - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """States that transitions lead to, -1 where they are not compiled."""
        out = np.full(len(keys), -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.to[slot[hit]]
            on = ~hit & (there >= 0)
            left, slot = left[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _keep(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Put transitions that are not there yet into the table."""
        self.held += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.to[slot[put]] = keys[put], to[put]
            on = np.ones(len(keys), dtype=bool)
            on[put] = False
            keys, to, slot = keys[on], to[on], (slot[on] + 1) & (SLOTS - 1)

    def _compile(self, keys: np.ndarray) -> None:
        """Transitions of states by bytes (state * 256 + byte), each once."""
        byte, state = keys & 255, [self.states[k] for k in (keys >> 8).tolist()]
        # the tokens being read, and one that starts here, of all keys one after another
        new = [self.root * self.size + (last if last >= 0 else self.size - 1) for last, _ in state]
        every = np.array([x for (_, open_), y in zip(state, new) for x in (*open_, y)], dtype=np.int64)
        of = np.repeat(np.arange(len(keys)), [len(open_) + 1 for _, open_ in state])
        node, left = self.goto[self.row[every // self.size], byte[of]].astype(np.int64), every % self.size
        alive = node >= 0
        node, left, of = node[alive], left[alive], of[alive]
        ends = np.flatnonzero(self.end[node] >= 0)
        token, fits = self.end[node[ends]], left[ends] == self.size - 1
        fits[~fits] = self._undo(left[ends[~fits]], token[~fits])
        last = np.full(len(keys), -1, dtype=np.int64)
        last[of[ends[fits]]] = token[fits]
        on = self.row[node] > 0
        further, count = (node[on] * self.size + left[on]).tolist(), np.bincount(of[on], minlength=len(keys))
        stop = np.cumsum(count).tolist()
        made = [self._state((t, tuple(further[b - n : b]))) for t, b, n in zip(last.tolist(), stop, count.tolist())]
        self._keep(keys, np.array(made, dtype=np.int32))

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte; compiles what is missing."""
        keys = state.astype(np.int64) << 8 | byte
        out = self._find(keys)
        missing = np.unique(keys[out < 0])
        if len(missing):
            self._compile(missing)
            rest = out < 0
            out[rest] = self._find(keys[rest])
        return out

    def encode_words(self, words: list) -> list:
        """Ids of pre-split words (bytes), each a list of int."""
        out: list = [None] * len(words)
        for picked, tokens, ends in self._blocks(words):
            tokens, first = tokens.tolist(), 0
            for k, last in zip(picked, ends.tolist()):
                out[k] = tokens[first:last]
                first = last
        return out

    def _blocks(self, words: list):
        """(numbers of words, their tokens one after another, where each word's end)."""
        order = sorted(range(len(words)), key=[-len(w) for w in words].__getitem__)
        for at in range(0, len(order), BLOCK):
            picked = order[at : at + BLOCK]
            yield picked, *self._encode_block([words[k] for k in picked])

    def _encode_block(self, words: list) -> tuple:
        """Tokens of words, longest first, and where each word's end."""
        length = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(length) - length
        last = np.empty(len(flat), dtype=np.int32)  # the arc that ends after every byte
        state = np.zeros(len(words), dtype=np.int32)
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for i, n in enumerate(active.tolist()):
            if len(self.states) > MOST_STATES or self.held > SLOTS // 2:
                used, state = np.unique(state[:n], return_inverse=True)
                kept = [self.states[k] for k in used.tolist()]
                self._start(kept)
                state = np.array([self.number[x] for x in kept], dtype=np.int32)[state]
            state = self._step(state[:n], flat[start[:n] + i])
            last[start[:n] + i] = self.last[state]
        # backwards from the last state, one token of every word at a time
        at, w, found, of = length.copy(), np.flatnonzero(length), [], []
        while len(w):
            token = last[start[w] + at[w] - 1]
            found.append(token)
            of.append(w)
            at[w] -= self.label_len[token]
            w = w[at[w] > 0]
        if not found:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        token, of = np.concatenate(found[::-1]), np.concatenate(of[::-1])
        return token[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(words)))

    def split(self, text: str) -> list:
        return self.pattern.findall(text)

    def encode_units(self, units: list) -> list:
        """(number of ids, decimals joined by commas, bytes of the arc labels)."""
        # letters with a space before them at most are one word
        cut = [u if u.isascii() and (u.isalpha() or u[:1] == " " and u[1:].isalpha()) else self.split(u) for u in units]
        texts = {w for ws in cut if ws.__class__ is list for w in ws}
        texts.update([ws for ws in cut if ws.__class__ is str])
        texts = list(texts)
        done: dict = {}
        for picked, tokens, ends in self._blocks([w.encode("utf-8", "surrogatepass") for w in texts]):
            tokens, first = tokens.tolist(), 0
            decimals, labels = [self.decimals[t] for t in tokens], [self.labels[t] for t in tokens]
            for k, last in zip(picked, ends.tolist()):
                done[texts[k]] = (last - first, b",".join(decimals[first:last]), b"".join(labels[first:last]))
                first = last
        out = []
        for ws in cut:
            if ws.__class__ is str:
                out.append(done[ws])
            else:
                got = [done[w] for w in ws]
                out.append((sum([x[0] for x in got]), b",".join([x[1] for x in got]), b"".join([x[2] for x in got])))
        return out

    def encode(self, text: str) -> list:
        """Ids of a whole text, special tokens' strings as their ids."""
        if self.special:
            parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
        else:
            parts = [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for ids in self.encode_words([w.encode() for w in self.split(part)]):
                    out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.labels[t] for t in ids).decode("utf-8", "replace")


_AUTOMATA: dict = {}


def automaton(path: str) -> BpeAutomaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = BpeAutomaton(path)
    return _AUTOMATA[path]
