"""6. Embedding near-duplicates by navigable small-world graphs, one hierarchy per shard.

Equal vectors are collapsed first. The distinct ones are dealt to shards of bounded bytes by a hash; each shard task
reads its vectors, builds its layers, then streams the queries of the same dimension through them in batches, so memory holds one
shard and one batch. Of two shards one asks the other, and a link counts for both its ends; inside a shard all members ask. Shards are kept so small that narrow beams find
what they should, for a beam's width costs more than a further shard. Searches run in lockstep: a step advances every query of a batch by numpy operations.

Links come from the graph, by one rule at every size: a beam search finds a query's nearest members, and those it links with lead to their
clumps (members that their own beam searches linked, directly or in a chain), whose members are all compared with the query. So a beam need not be as wide as a group
is large. Cosines are computed in double precision; links are counted and united block by block and dropped.

A shard's beam is settled by an audit before it answers: AUDITED queries, those with the smallest hashes (all, if there are fewer), are compared with the whole shard. Where the mean
recall of the queries with up to FEW links, or of those with more, is under RECALL, the beam doubles; past WIDEST the shard is compared with all queries whole, the exact end. audits() gives
each shard's figures, its layers among them. Shards of up to LEAST members have no layers and are compared whole; in all others only the top layer, of about DIRECT rows, is scanned, the others are navigated.

A task emits, per query, its count of links, and the edges of a forest over queries and shard members (never all
pairs of a group); components() unites the shards' forests.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
are their own component; vectors of different dimensions don't link; magnitudes don't matter, however large or small; a cosine equal to the threshold links;
rows repeating a vec_id give one row each and count as other vectors; rows with a null id have null component and link with
nothing; an empty table gives no rows; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: Neighbours kept in upper layers (twice as many in the lowest), beams for building and searching, audited queries of a shard, wanted recall.
M, BUILD_BEAM, BEAM, AUDITED, RECALL = 16, 64, 16, 4096, 0.99
#: Up to so many links a query counts as one with few, whose recall is judged apart.
FEW = 16
#: The widest beam; a shard whose audit fails even so is compared whole.
WIDEST = 256
#: Places in each list for links to members that nothing else leads to.
REPAIRS = 4
#: Members of a shard that has no graph; rows of the top layer, which are compared directly; first rows of a layer that are linked at once; members that a further shard needs, up to those asked for; members of a shard at most, about; places of a query that a step goes on from; numbers gathered by a step (sets how many queries go at once).
LEAST, DIRECT, TOP, A_SHARD, MEMBERS, WAVE, GATHERED = 64, 32, 256, 1024, 24_576, 4, 1 << 24
#: Pairs of a query and a row of which a search notes whether they met; similarities computed at once.
SEEN, STEP = 1 << 24, 1 << 15
#: Queries and members of a block that is compared at once; pairs whose cosines are computed at once; members of a clump that is compared pair by pair.
ROWS, COLUMNS, PAIRS, SMALL = 256, 4096, 1 << 16, 32


def lanes(d: int) -> int:
    """Vectors of d components that are searched at once."""
    return max(64, min(4096, GATHERED // (2 * M * WAVE * d)))


def _sims(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """rows (n, k, d) against q (n, d)."""
    return np.matmul(rows, q[:, :, None])[:, :, 0]


class Graph:
    """A layered graph over unit vectors v (float32)."""

    def __init__(self, v: np.ndarray, seed: int = 7):
        self.v, n = v, len(v)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(M)).astype("i4"), 12)
        order = np.argsort(-level, kind="stable").astype("i4")  # higher layers are prefixes of lower ones
        size = [int((level >= k).sum()) for k in range(level.max(initial=0) + 1)]
        self.order = order
        self.u = v[order]
        top = next((k for k, s in enumerate(size) if s <= DIRECT), len(size) - 1)
        self.top = size[top] if size else 0
        self.layers: list[np.ndarray] = []
        if self.top == n:  # the lowest layer always has links
            self.top = max(1, n // M)
        while self.top > 4 * DIRECT:  # no layer is small: the first rows serve as one
            self.top //= 2
        at = self.top
        for k in range(top, -1, -1):
            if size and (size[k] > at or k == 0):
                self._build(size[k], at, 2 * M if k == 0 else M)
                at = size[k]

    def _entry(self, q: np.ndarray, keep: int) -> np.ndarray:
        s = q @ self.u[: self.top].T
        return np.argpartition(-s, min(keep, self.top) - 1, axis=1)[:, :keep].astype("i4")

    def _search(self, q: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search in lockstep, WAVE places of each query at a step -> places and similarities, best first; -1 where none."""
        step = max(64, SEEN // len(links))
        parts = [self._walk(q[x : x + step], links, entry[x : x + step], beam) for x in range(0, max(len(q), 1), step)]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _walk(self, q: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(q), len(links)
        ids, sims = np.full((n, beam), -1, "i4"), np.full((n, beam), -np.inf, "f4")
        w = min(entry.shape[1], beam)
        ids[:, :w] = entry[:, :w]
        sims[:, :w] = np.where(ids[:, :w] >= 0, _sims(self.u[ids[:, :w]], q), -np.inf)
        done = ids < 0
        seen, last = np.zeros(n * size, bool), np.empty(n * size, "u1")  # of each query and row: whether it was met, and where a step met it last
        seen[(np.arange(n)[:, None] * size + ids[:, :w])[ids[:, :w] >= 0]] = True
        live = np.arange(n)
        while len(live):
            i, s, d = ids[live], sims[live], done[live]
            open_ = np.where(d, -np.inf, s)
            best = np.argpartition(-open_, min(WAVE, beam) - 1, axis=1)[:, :WAVE]
            going = (np.take_along_axis(open_, best, 1) > -np.inf).any(1)
            if not going.all():
                live, i, s, d, best = live[going], i[going], s[going], d[going], best[going]
                if not len(live):
                    break
            at = np.where(np.take_along_axis(d, best, 1), -1, np.take_along_axis(i, best, 1))
            np.put_along_axis(d, best, True, 1)
            done[live] = d
            new = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1)
            a, b = np.nonzero(new >= 0)
            new = new[a, b]
            key = live[a] * size + new
            first = np.flatnonzero(~seen[key])
            a, b, new, key = a[first], b[first], new[first], key[first]
            last[key] = b
            first = np.flatnonzero(last[key] == b)
            a, new = a[first], new[first]
            seen[key[first]] = True
            t = np.empty(len(a), "f4")
            for x in range(0, len(a), STEP):
                t[x : x + STEP] = np.einsum("ij,ij->i", self.u[new[x : x + STEP]], q[live[a[x : x + STEP]]])
            some = np.flatnonzero(t > s.min(1)[a])  # what a beam can't take is out
            if not len(some):
                continue
            a, new, t = a[some], new[some], t[some]
            count = np.bincount(a, minlength=len(live))
            rows = np.flatnonzero(count)
            place = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            more, t_more = np.full((len(live), count.max()), -1, "i4"), np.full((len(live), count.max()), -np.inf, "f4")
            more[a, place], t_more[a, place] = new, t
            ci, cs = np.concatenate([i[rows], more[rows]], 1), np.concatenate([s[rows], t_more[rows]], 1)
            cd = np.concatenate([d[rows], more[rows] < 0], 1)
            take = np.argpartition(-cs, beam - 1, axis=1)[:, :beam]
            ids[live[rows]], sims[live[rows]], done[live[rows]] = (np.take_along_axis(x, take, 1) for x in (ci, cs, cd))
        o = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)

    def _chosen(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (best first), those nearer to it than to one already chosen; then the nearest of the rest."""
        n, c = cand.shape
        x = self.u[cand]
        among = np.matmul(x, x.transpose(0, 2, 1))
        ok, taken = np.zeros((n, c), bool), np.zeros(n, "i4")
        worst = np.full((n, c), -np.inf, "f4")
        for k in range(c):
            ok[:, k] = (cand[:, k] >= 0) & (sims[:, k] > worst[:, k]) & (taken < most)
            taken += ok[:, k]
            worst = np.where(ok[:, k, None], np.maximum(worst, among[:, k]), worst)
        rank = np.where(cand < 0, 3 * c, np.where(ok, 0, c) + np.arange(c))
        take = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(rank, take, 1) < 3 * c, np.take_along_axis(cand, take, 1), -1)

    def _build(self, size: int, start: int, width: int) -> None:
        links = np.full((size, width), -1, "i4")
        at = 0
        while at < size:
            stop = min(size, max(at * 2, TOP), at + lanes(self.u.shape[1]))
            q = self.u[at:stop]
            k = min(BUILD_BEAM, stop)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            near = np.argpartition(-own, min(k, len(q)) - 1, axis=1)[:, : min(k, len(q))]
            cand, sims = (near + at).astype("i4"), np.take_along_axis(own, near, 1)
            if at:
                entry = np.where((e := self._descend(q, 8)) < at, e, 0).astype("i4") if self.layers else np.argpartition(-(q @ self.u[: min(at, self.top)].T), min(8, at) - 1, axis=1)[:, :8].astype("i4")
                ci, cs = self._search(q, links, entry[:, :1] if entry.shape[1] < 1 else _first_only(entry), BUILD_BEAM)
                cand, sims = np.concatenate([cand, ci], 1), np.concatenate([sims, cs], 1)
            cand[~(sims > -np.inf)] = -1
            o = np.argsort(-sims, axis=1)[:, :BUILD_BEAM]
            cand, sims = np.take_along_axis(cand, o, 1), np.take_along_axis(sims, o, 1)
            mine = self._chosen(cand, sims, width // 2)
            links[at:stop, : mine.shape[1]] = mine
            # and back: each chosen one gets the new one too, its list chosen anew if too long
            src = np.repeat(np.arange(at, stop, dtype="i4"), mine.shape[1])
            dst = mine.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            o = np.argsort(dst, kind="stable")
            src, dst = src[o], dst[o]
            nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
            nth = np.arange(len(dst)) - np.repeat(first, count)
            for a in range(0, int(count.max(initial=0)), width):
                here = (nth >= a) & (nth < a + width)
                rows = np.unique(dst[here])
                more = np.full((len(rows), width), -1, "i4")
                more[np.searchsorted(rows, dst[here]), nth[here] - a] = src[here]
                more[(more[:, :, None] == links[rows][:, None, :]).any(2)] = -1
                both = np.concatenate([links[rows], more], 1)
                s = np.where(both >= 0, _sims(self.u[both], self.u[rows]), -np.inf)
                o = np.argsort(-s, axis=1)
                links[rows] = self._chosen(np.take_along_axis(both, o, 1), np.take_along_axis(s, o, 1), width)
            at = stop
        if width == 2 * M:
            links = self._connected(links, max(1, start))
        self.layers.append(links)

    def _connected(self, links: np.ndarray, sources: int) -> np.ndarray:
        """The lowest layer with links to what its first rows (those of the layer above) don't lead to, from the nearest they do."""
        links = np.concatenate([links, np.full((len(links), REPAIRS), -1, "i4")], axis=1)
        for k in range(2 * REPAIRS):
            seen, wave = np.zeros(len(links), bool), np.arange(sources)
            seen[wave] = True
            while len(wave):
                wave = np.unique(links[wave])
                wave = wave[(wave >= 0) & ~seen[wave]]
                seen[wave] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                break
            near = self._search(self.u[lost], links, _first_only(self._descend(self.u[lost], 8)), BUILD_BEAM)[0][:, 0]
            near, first = np.unique(near, return_index=True)
            links[near, 2 * M + k % REPAIRS] = lost[first]
        return links

    def _descend(self, q: np.ndarray, beam: int) -> np.ndarray:
        entry = self._entry(q, beam)
        for links in self.layers:
            if links.shape[1] > M:  # the lowest
                break
            entry = self._search(q, links, entry, beam)[0]
        return entry

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        beam = min(beam, len(self.u))
        ids, sims = self._search(q, self.layers[-1], _first_only(self._descend(q, beam)), beam)
        return np.where(ids >= 0, self.order[ids], -1), sims


def _first_only(entry: np.ndarray) -> np.ndarray:
    """Entries without repeats in a row."""
    s = np.sort(entry, axis=1)
    s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
    return s


def _passes(true: np.ndarray, found: np.ndarray) -> bool:
    """Whether the mean recall of the queries with few links, and that of those with more, are as wanted."""
    few = (true > 0) & (true <= FEW)
    return all(not k.any() or (found[k] / true[k]).mean() >= RECALL for k in (few, true > FEW))


class Shard:
    """A shard's vectors (unit rows, double precision) with its graph, and the forest of the links found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, threshold: float):
        self.ids, self.exact, self.copies, self.threshold = ids, vectors, copies, threshold
        self.near = np.float32(threshold - 1e-5)  # what single precision may take for a link
        self.flat = vectors.astype("f4")
        self.graph = Graph(self.flat) if len(ids) > LEAST else None
        self.up = np.arange(len(ids))
        self.asked = np.zeros(len(ids), "i8")  # links of each member with the queries of other shards
        self.beam, self.audit = 0, (0, 0, 0, 1.0)

    def settle(self, ids: np.ndarray, q: np.ndarray) -> None:
        """Choose the beam by an audit with these queries."""
        true = sum((np.bincount(a, minlength=len(ids)) for a, _ in self._scanned(ids, q)), np.zeros(len(ids), "i8"))
        self.beam, found = 0, true
        if self.graph is not None:
            self.beam = BEAM
            while self.beam <= WIDEST:
                self._clumps()
                found = sum((np.bincount(a, minlength=len(ids)) for a, _ in self._searched(ids, q)), np.zeros(len(ids), "i8"))
                if _passes(true, found):
                    break
                self.beam *= 2
            else:
                self.beam, found = 0, true
        some = true > 0
        self.audit = len(ids), int(true.sum()), int(found.sum()), float((found[some] / true[some]).mean()) if some.any() else 1.0

    def _hits(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) places that beam searches take for links."""
        near, sims = self.graph.search(q.astype("f4"), self.beam)
        a, k = np.nonzero((sims >= self.near) & (near >= 0) & (self.ids[near] != ids[:, None]))
        return a, near[a, k]

    def _clumps(self) -> None:
        """Unite the members that their own searches link, and number the clumps."""
        for x in range(0, len(self.ids), lanes(self.flat.shape[1])):
            rows = slice(x, x + lanes(self.flat.shape[1]))
            for a, b in self._verified(*self._hits(self.ids[rows], self.exact[rows]), self.ids[rows], self.exact[rows]):
                self._unite(a + x, b)
        root = self._root(np.arange(len(self.ids)))
        self.sorted = np.argsort(root, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(root[self.sorted]) > 0])
        self.start, self.size = first, np.diff(np.r_[first, len(root)])
        self.clump = np.empty(len(root), "i8")
        self.clump[self.sorted] = np.repeat(np.arange(len(first)), self.size)

    def _verified(self, a, b, ids, q):
        """Of the pairs (a of q, b of members) those with a cosine of at least the threshold."""
        for z in range(0, len(a), PAIRS):
            x, y = a[z : z + PAIRS], b[z : z + PAIRS]
            ok = (ids[x] != self.ids[y]) & (np.einsum("ij,ij->i", q[x], self.exact[y]) >= self.threshold)
            if ok.any():
                yield x[ok], y[ok]

    def _searched(self, ids: np.ndarray, q: np.ndarray):
        """(query, member) places of links, by the graph: each query against the clumps its beam leads to."""
        a, b = self._hits(ids, q)
        pair = np.unique(a * len(self.start) + self.clump[b])
        a, c = pair // len(self.start), pair % len(self.start)
        small = self.size[c] <= SMALL
        x, k = a[small], c[small]
        for z in range(0, len(x), PAIRS // SMALL):
            own, n = k[z : z + PAIRS // SMALL], self.size[k[z : z + PAIRS // SMALL]]
            place = np.repeat(self.start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield from self._verified(np.repeat(x[z : z + PAIRS // SMALL], n), self.sorted[place], ids, q)
        x, k = a[~small], c[~small]
        for own in np.unique(k):
            members = self.sorted[self.start[own] : self.start[own] + self.size[own]]
            yield from self._blocks(x[k == own], members, ids, q)

    def _scanned(self, ids: np.ndarray, q: np.ndarray):
        """(query, member) places of all links."""
        yield from self._blocks(np.arange(len(q)), np.arange(len(self.ids)), ids, q)

    def _blocks(self, rows, members, ids, q):
        """Links of these queries with these members, ROWS x COLUMNS pairs at a time."""
        for x in range(0, len(rows), ROWS):
            r = rows[x : x + ROWS]
            flat = q[r].astype("f4")
            for y in range(0, len(members), COLUMNS):
                m = members[y : y + COLUMNS]
                a, b = np.nonzero(flat @ self.flat[m].T >= self.near)
                yield from self._verified(r[a], m[b], ids, q)

    def query(self, ids: np.ndarray, q: np.ndarray, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """-> links of each query, the queries that have an edge and the member each is joined to. copies: of queries whose links count for the members too."""
        n, first = np.zeros(len(ids), "i8"), np.full(len(ids), -1)
        for a, b in self._searched(ids, q) if self.beam else self._scanned(ids, q):
            n += np.bincount(a, weights=self.copies[b], minlength=len(ids)).astype("i8")
            if copies is not None:
                self.asked += np.bincount(b, weights=copies[a], minlength=len(self.ids)).astype("i8")
            row, at = np.unique(a, return_index=True)
            first[row] = np.where(first[row] < 0, b[at], first[row])
            self._unite(b, first[a])
        rows = np.flatnonzero(first >= 0)
        return n, rows, first[rows]

    def _unite(self, x: np.ndarray, y: np.ndarray) -> None:
        """Join members x and y: all labels of a pair sink to the smaller one until none differ."""
        while len(x):
            rx, ry = self._root(x), self._root(y)
            differ = rx != ry
            x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
            np.minimum.at(self.up, np.maximum(rx, ry), np.minimum(rx, ry))

    def _root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while not np.array_equal(r, self.up[r]):
            r = self.up[r]
        self.up[x] = r
        return r


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as unit rows in double precision; each row is scaled by its largest component first."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    v = flat.reshape(len(column), -1)
    v = v / np.abs(v).max(1)[:, None]
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


#: What a shard task's rows are: members, queries that are only audited, queries of other shards; and what it emits: counts, edges, the audit.
MEMBER, AUDITING, ASKED = range(3)
COUNT, EDGE, AUDIT = range(3)
_FOUND = "kind int, a long, b long, n long, recall double, layers int"


def _shards(threshold: float):
    """Rows (d, shard, role, key, copies, embedding), sorted by the first three -> counts, edges and audits."""

    def out(kind, a, b, n, recall=None, layers=None):
        cols = pa.array(np.full(len(a), kind, "i4")), pa.array(a, "int64"), pa.array(b, "int64"), pa.array(n, "int64"), pa.array(recall or [None] * len(a), "float64"), pa.array(layers or [None] * len(a), "int32")
        return pa.RecordBatch.from_arrays(list(cols), names=[c.split()[0] for c in _FOUND.split(", ")])

    def run(batches):
        shard, now, rows = None, None, {MEMBER: [], AUDITING: [], ASKED: []}

        def taken(role):
            got = [np.concatenate(x) for x in zip(*rows[role], strict=True)]
            rows[role] = []
            return got

        def opened():
            """The shard, built and audited once its first rows are all there."""
            nonlocal shard
            if shard is None and rows[MEMBER]:
                ids, v, copies = taken(MEMBER)
                shard = Shard(ids, v, copies, threshold)
                if rows[AUDITING]:
                    shard.settle(*taken(AUDITING)[:2])
                queries, links, found, recall = shard.audit
                yield out(AUDIT, [len(ids)], [shard.beam], [queries], [recall], [len(shard.graph.layers) + 1 if shard.graph else 0])

        def counted(ids, n):
            some = np.flatnonzero(n)
            yield out(COUNT, ids[some], ids[some], n[some])

        def answered(ids, v, copies=None):
            n, who, to = shard.query(ids, v, copies)
            yield from counted(ids, n)
            yield out(EDGE, ids[who], shard.ids[to], np.zeros(len(who), "i8"))

        def closed():
            nonlocal shard
            yield from opened()
            if shard is not None:
                if rows[ASKED]:
                    yield from answered(*taken(ASKED))
                step = lanes(shard.exact.shape[1])
                for x in range(0, len(shard.ids), step):
                    yield from answered(shard.ids[x : x + step], shard.exact[x : x + step])
                yield from counted(shard.ids, shard.asked)
                root = shard._root(np.arange(len(shard.ids)))
                joined = np.flatnonzero(root != np.arange(len(root)))
                yield out(EDGE, shard.ids[joined], shard.ids[root[joined]], np.zeros(len(joined), "i8"))
            shard = None
            for x in rows.values():  # a shard without members answers nothing
                x.clear()

        for batch in batches:
            d, s, roles, keys, copies = (batch.column(k).to_numpy() for k in range(5))
            cuts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (roles[1:] != roles[:-1]), True])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if y == x:
                    continue
                if (d[x], s[x]) != now:
                    yield from closed()
                    now = d[x], s[x]
                role = int(roles[x])
                if role == ASKED:
                    yield from opened()
                    if shard is None:
                        continue
                rows[role].append((keys[x:y], _matrix(batch.column(5).slice(x, y - x)), copies[x:y]))
                if role == ASKED and sum(len(r[0]) for r in rows[ASKED]) >= lanes(d[x]):
                    yield from answered(*taken(ASKED))
        yield from closed()

    return run


def _search(vectors: DataFrame, threshold: float, shards: int, shard_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> all rows with their key's parts, the distinct vectors (written, with a key), what the shards found (written)."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    # adding 0.0 makes -0.0 and 0.0 one, so that equal vectors are equal keys
    zero = F.lit(0.0).cast(vectors.schema["embedding"].dataType.elementType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + zero).alias("embedding"),
                          F.coalesce(F.col("vec_id").isNotNull() & fine, F.lit(False)).alias("valid"))
    reps = rows.where("valid").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = written(reps.select("embedding", "rep", "copies", F.size("embedding").alias("d"), F.monotonically_increasing_id().alias("key")))
    # shards of each dimension: as many as asked, fewer for few vectors, more where one would pass MEMBERS or shard_bytes
    n = F.greatest(F.lit(1), F.least(F.lit(shards), F.ceil(F.col("n") / A_SHARD)), F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("n") * F.col("d") * 4 / shard_bytes)).cast("int")
    sizes = written(reps.groupBy("d").agg(F.count("*").alias("n")).select("d", "n", n.alias("shards")))
    # half of a key's hash deals it to a shard, the other half chooses it for the audits
    h = F.xxhash64("key")
    dealt = reps.join(sizes, "d").select("*", F.pmod(F.shiftright(h, 32), F.col("shards")).cast("int").alias("own"), F.pmod(h, F.lit(1 << 32)).alias("u"))
    row = lambda df, shard, role: df.select("d", shard.alias("shard"), F.lit(role).alias("role"), "key", "copies", "embedding")
    members = row(dealt, F.col("own"), MEMBER)
    audited = row(dealt.where(F.col("u") < F.lit(AUDITED * 2.0**32) / F.col("n")), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)), AUDITING)
    # a shard asks the half of the others that follow it; of two that are opposite the first asks
    others = F.floor((F.col("shards") - 1) / 2) + F.when((F.col("shards") % 2 == 0) & (F.col("own") < F.col("shards") / 2), 1).otherwise(0)
    asked = row(dealt, F.explode(F.when(others > 0, F.transform(F.sequence(F.lit(1), others.cast("int")), lambda t: F.pmod(F.col("own") + t, "shards")))), ASKED)
    tasks = max(shards, sizes.agg(F.max("shards")).first()[0] or 0)
    found = members.unionAll(audited).unionAll(asked).repartitionById(tasks, F.pmod(F.col("d") + F.col("shard"), F.lit(tasks)).cast("int")).sortWithinPartitions("d", "shard", "role")
    return rows, reps, written(found.mapInArrow(_shards(threshold), _FOUND))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, *, shards: int = 6, shard_bytes: int = 32 << 20) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept. At least `shards` shards; more where one would pass shard_bytes of single-precision components."""
    return with_audits(vectors, threshold, shards=shards, shard_bytes=shard_bytes)[0]


def with_audits(vectors: DataFrame, threshold: float = 0.9, *, shards: int = 6, shard_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """near_duplicates' rows, and a row per shard: members, beam (0: compared whole), audited queries, their mean recall, layers (with the one that is scanned)."""
    rows, reps, found = _search(vectors, threshold, shards, shard_bytes)
    links = found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    groups = components(found.where(F.col("kind") == EDGE).select("a", "b")).withColumnRenamed("node", "key")
    of = reps.join(links, "key", "left").join(groups, "key", "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "key").alias("group"), "rep")
    of = of.join(of.groupBy("group").agg(F.min("rep").alias("component_id")), "group").select(F.col("embedding").alias("e"), "n_links", "component_id")
    linked = rows.where("valid").join(of, F.col("embedding") == F.col("e")).select("vec_id", "n_links", "component_id")
    rest = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    all_rows = linked.unionAll(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    audits = found.where(F.col("kind") == AUDIT).select(F.col("a").alias("members"), F.col("b").alias("beam"), F.col("n").alias("audited"), "recall", "layers")
    return all_rows, audits
