"""Fuzzy line dedup.

1. Lines are normalised: letters of ASCII and Latin-1 in lower case, punctuation and white space one
   space (and, if `fold_digits`, every digit 0). Equal normalised lines are one line from there on.
2. Each distinct line gets a 64-bit SimHash of its distinct words, and a row of SimHash blocks. Its words of
   LONG bytes or more, which say more than short ones, are dealt by their hash to B blocks, B a power of two that grows with
   the line, so that a block holds a few words at any length; each block is the SimHash of what was dealt to it. A
   changed word touches at most two blocks: the one it leaves and the one its successor comes to. So lines
   that differ in d words agree in a whole block if B > 2 d (pigeonhole), and likely beyond that, since words are
   dealt anew, with another hash, until a line has `keys` blocks. Lines of up to SHORT words, or with fewer than FEW long ones, also
   have blocks of character trigrams, and lines of up to TINY code points, which may differ in one, the blocks
   that one code point left out leaves of them.
3. Lines meet on each equal block. Those whose whole SimHashes differ in at most `distance` bits, and whose
   lengths allow it, are linked if their edit similarity, 1 - edits / longer length, is `percent` / 100 or more.
4. Of each group that links connect, the first occurrence stays: the least doc_id (null last), then the
   row, then the line. All others go.

Blocks of bits of one SimHash don't give right results here: of the pairs with edit similarity 0.8 or more in the
test tables a third are within 3 bits, and 95 % within 10 only, where pigeonhole blocks are too short to be
selective. README has the measured recall of the blocks above.

Verifying takes two steps, and needs no list of all pairs. First, at each block every line is compared with two others
within the distance, the most frequent one and the nearest one, so a block that many lines share costs as many
comparisons of texts as lines, twice. What that links are classes. Then each block where more pairs are within the distance, and
whose lines are of several classes, compares all those pairs that are not of one class yet (`settle`); it gives a link for
each two classes that it joins, never a row a pair. So lines are in one group just if links of all pairs that meet connect them.

Scale: equal lines of one block of rows are sent once, so a line that stands everywhere costs each bucket
one entry a block; line keys, SimHash blocks and answers travel as packed arrays, one row for each block and bucket;
line texts travel only for lines that have a neighbour; documents never travel, since removals come to
their blocks.

Defined cases: lines without a letter or digit are kept as they are and never link; a null text stays
null; lines are parted by \\n alone; repeated rows are duplicates of each other line by line, so the
first keeps all; a text that loses all its lines becomes empty; an empty table gives an empty result;
a null doc_id sorts last; other columns are carried along, and columns named n_lines or n_removed are
replaced. A text may have up to 2**30 lines, and its memory is that of the text and some 40 bytes a word of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import textkernel as K
from tessaline.llm.blocks import blocks, deal, over, unzip_bytes, with_answers, zip_bytes
from tessaline.operators.components import connected_components
from tessaline.session import shuffle_width, written

U64 = np.uint64
#: Everything of ASCII but letters and digits parts words.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[c for c in range(128) if not chr(c).isalnum()]] = True
_FOLD = K.LOWER.copy()
_FOLD[0x30:0x3A] = 0x30


def _lower(data: np.ndarray, table: np.ndarray = K.LOWER) -> tuple[np.ndarray, np.ndarray]:
    upper = np.zeros(len(data), dtype=bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)
    out = table[data]
    out[upper] += 0x20
    return out, np.zeros(len(data), dtype=bool)


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _lower(data, _FOLD)


def lines_of(texts: pa.Array, fold_digits: bool = False) -> Iterator[tuple[int, K.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, words, line ends, first line of each text, first word of each line) for some texts at a time."""
    for a, b, w in K.of_array(texts, BREAKS, refine=_folded if fold_digits else _lower):
        ends = np.flatnonzero(w.data == 0x0A)  # each text ends in one
        first_line = np.concatenate(([0], np.searchsorted(ends, w.text_end) + 1))
        yield a, w, ends, first_line, np.concatenate(([0], np.searchsorted(w.begin, ends)))


#: The bits of each byte, one in each byte of a word, so that eight counters are added at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U64).ravel()


def simhashes(prints: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each run of words; first[i]:first[i + 1] must not be empty.

    One byte counts up to 255 words: longer runs are counted in parts, and the parts are added.
    """
    if len(first) < 2:
        return np.zeros(0, dtype=U64)
    size = np.diff(first)
    parts = -(-size // 255)
    begin = np.repeat(first[:-1], parts) + 255 * K.ragged(np.zeros(len(size), dtype=np.int64), parts)
    octets = np.ascontiguousarray(prints[: first[-1]]).view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.add.reduceat(_SPREAD[octets[:, k]], begin) for k in range(8)], axis=1)
    ones = counts.view(np.uint8).astype(np.int32)
    if len(begin) > len(size):
        ones = np.add.reduceat(ones, np.cumsum(parts) - parts, axis=0)
    return np.packbits(2 * ones > size[:, None], axis=1).view(U64).ravel()


def _small_simhashes(prints: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The SimHash of each run prints[begin:begin + size]; runs of up to 15 are counted in four bit planes."""
    out = np.zeros(len(begin), dtype=U64)
    who = np.flatnonzero(size > 15)
    if len(who):
        out[who] = simhashes(prints[K.ragged(begin[who], size[who])], np.concatenate(([0], np.cumsum(size[who]))))
    for n in np.unique(size[size <= 15]).tolist():
        who = np.flatnonzero(size == n)
        planes: list[np.ndarray] = []
        for k in range(n):
            carry = prints[begin[who] + k]
            for i, p in enumerate(planes):
                planes[i], carry = p ^ carry, p & carry
            if not k & (k + 1):  # up to here no carry has left the planes
                planes.append(carry)
        more, same = np.zeros(len(who), dtype=U64), np.full(len(who), (1 << 64) - 1, dtype=U64)
        for i in reversed(range(len(planes))):  # the count of each bit against n // 2, from the highest plane on
            if (n // 2) >> i & 1:
                same &= planes[i]
            else:
                more |= same & planes[i]
                same &= ~planes[i]
        out[who] = more
    return out


#: Features a block at least, words and trigrams a block about, bytes of a long word; words, long words and code points of lines with more blocks; salts of the dealings.
LEAST, WORDS, GRAMS, LONG, SHORT, FEW, TINY = 2, 2.0, 6.0, 5, 10, 8, 9
FACTORS = K.mix(np.arange(1, 257, dtype=U64)) | U64(1)


def simhash_blocks(prints: np.ndarray, first: np.ndarray, per_block: float, keys: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(whose, key): the blocks of each run of features, a key for each that holds LEAST features or more.

    A run whose number of features is within 6 % of the next number of blocks is dealt to both, so
    that runs of near lengths are dealt alike.
    """
    size = np.diff(first)
    low, high = (np.floor(np.log2(np.maximum(1.0, share * size / per_block))).astype(np.int64) for share in (0.94, 1.06))
    (whose, starts, sizes), (salts, runs), total = ([np.zeros(0, dtype=np.int64)] for _ in range(3)), ([np.zeros(0, dtype=U64)] for _ in range(2)), 0
    for level in np.unique(np.concatenate([low, high])).tolist():
        some = np.flatnonzero((low <= level) & (level <= high) & (size > 0))
        if not len(some):
            continue
        blocks = 1 << level
        mine, owner = prints[K.ragged(first[:-1][some], size[some])], np.repeat(np.arange(len(some)) << level, size[some])
        for turn in range(-(-keys // blocks) if level else 1):
            dealt, place = mine, owner
            if level:
                block = ((mine * FACTORS[turn]) >> U64(64 - level)).astype(np.int64)
                left = keys - turn * blocks
                if left < blocks:
                    kept = block < left
                    dealt, place, block = mine[kept], owner[kept], block[kept]
                place = place + block
                order = np.argsort(place)
                dealt, place = dealt[order], place[order]
            begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
            n = np.diff(np.append(begin, len(place)))
            begin, n = begin[n >= LEAST], n[n >= LEAST]
            place = place[begin]
            salt = (place & (blocks - 1)) + ((kind << 40) + (level << 20) + turn * blocks)
            whose.append(some[place >> level])
            salts.append(salt.astype(U64))
            runs.append(dealt)
            starts.append(begin + total)
            sizes.append(n)
            total += len(dealt)
    sims = _small_simhashes(np.concatenate(runs), np.concatenate(starts), np.concatenate(sizes))
    return np.concatenate(whose), K.mix(sims + K.mix(np.concatenate(salts)))


def sketches(w: K.Words, begin: np.ndarray, end: np.ndarray, keys: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in begin, SimHashes, keys), an entry a block, of the lines begin:end, in words: by long words, and the short ones by trigrams, twice as many."""
    size = end - begin
    prints = w.fingerprints()
    # distinct words by 40 bits of their fingerprints; a chunk has fewer than 2**24 lines
    word = np.sort(np.repeat(np.arange(len(size), dtype=U64), size) << U64(40) | prints[K.ragged(begin, size)] >> U64(24))
    word = word[np.concatenate(([True], word[1:] != word[:-1]))] if len(word) else word
    sims = simhashes(K.mix(word & U64((1 << 40) - 1)), np.searchsorted(word >> U64(40), np.arange(len(size) + 1, dtype=U64)))
    at = K.ragged(begin, size)
    owner = np.repeat(np.arange(len(size)), size)
    long = (w.end - w.begin)[at] >= LONG
    many = np.bincount(owner[long], minlength=len(size))
    whose, found = simhash_blocks(prints[at[long]], np.concatenate(([0], np.cumsum(many))), WORDS, keys, 1)
    yield whose, sims[whose], found
    short = np.flatnonzero((size <= SHORT) | (many < FEW))
    if len(short):
        word = K.ragged(begin[short], size[short])
        room = w.end[word] - w.begin[word] + 1
        data = w.data[np.minimum(K.ragged(w.begin[word], room), len(w.data) - 1)]
        data[np.cumsum(room) - 1] = 0x20  # each word with one space behind it
        raw = data.tobytes()
        stop = np.cumsum(room)[np.cumsum(size[short]) - 1] - 1
        at = np.concatenate(([0], stop[:-1] + 1))
        size = stop - at
        data = np.concatenate(([0x20], data)).astype(U64)  # a space before and after each line
        grams = K.mix(data[:-2] | data[1:-1] << U64(8) | data[2:] << U64(16))
        whose, found = simhash_blocks(grams[K.ragged(at, size)], np.concatenate(([0], np.cumsum(size))), GRAMS, 2 * keys, 2)
        yield short[whose], sims[short[whose]], found
        who, left = [], []
        for i in np.flatnonzero(size <= 4 * TINY).tolist():
            text = raw[at[i] : at[i] + size[i]].decode()
            if len(text) <= TINY:
                for k in range(len(text) + 1):
                    who.append(short[i])
                    left.append(text[:k] + text[k + 1 :])
        if left:
            data, offsets = K.flat_bytes(pa.array(left, pa.string()))
            found = K.mix(K.span_fingerprints(data, offsets[:-1], offsets[1:]) + U64(3 << 40))
            yield np.array(who), np.zeros(len(who), dtype=U64), found


#: lid is the id of a line: its block, and its place among all lines of that block.
LINE_BITS = 30


def line_base(block_id: int) -> int:
    """The lid of the first line of a block; lids sort as (block_id, line) do."""
    part, n = block_id >> 20, block_id & 0xFFFFF
    if n >> 13 or part >> 20:
        raise ValueError(f"block {n} of partition {part}: at most 8192 blocks of a partition and 2**20 partitions can be told apart")
    return (part << 13 | n) << LINE_BITS


def block_of_line(lid):
    """The block_id of a lid column."""
    dense = F.shiftright(lid, LINE_BITS)
    return F.shiftleft(F.shiftright(dense, 13), 20) + dense.bitwiseAND(F.lit((1 << 13) - 1))


def line_of_lid(lid):
    return lid.bitwiseAND(F.lit((1 << LINE_BITS) - 1))


def _pack(x: np.ndarray) -> bytes:
    """Integers of one width, compressed byte by byte."""
    return zip_bytes(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T))


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzip_bytes(data), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


KEYS = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("lines", pa.binary()), ("key1", pa.binary()), ("key2", pa.binary()), ("docs", pa.binary()), ("nulls", pa.binary()), ("again", pa.binary())])


def _keys(block_id: int, rows: pa.Table, id_col: str, text_col: str, buckets: int, fold_digits: bool) -> Iterator[pa.RecordBatch]:
    """One row a bucket: the distinct lines of a block, each where it stands first, with two fingerprints; and where lines stand again."""
    ids = rows.column(id_col).cast(pa.int64()).combine_chunks()
    no_id = np.asarray(ids.is_null())
    ids = ids.fill_null(0).to_numpy()
    parts, base = [], 0
    for a, w, ends, first_line, first in lines_of(rows.column(text_col), fold_digits):
        some = np.flatnonzero(np.diff(first) > 0)
        prints = w.fingerprints()
        owner = np.searchsorted(first_line, some, side="right") - 1
        parts.append((base + some, *(K.run_fingerprints(prints, first[:-1][some], first[1:][some], k) for k in (0, 1)), ids[a + owner], no_id[a + owner]))
        base += len(ends)
    if base >> LINE_BITS:
        raise ValueError(f"{base} lines in one block of texts; at most 2**{LINE_BITS} can be told apart")
    line, key1, key2, doc, null = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.int64, U64, U64, np.int64, bool))
    order = np.lexsort((line, doc, null, key2, key1))
    same = np.concatenate(([False], (key1[order][1:] == key1[order][:-1]) & (key2[order][1:] == key2[order][:-1])))
    once, again = np.sort(order[~same]), np.sort(order[same])
    deals = [(x, *deal(key1[x], buckets)) for x in (once, again)]
    cols: dict[str, list] = {k: [] for k in KEYS.names}
    for bucket in np.union1d(deals[0][2], deals[1][2]).tolist():
        mine, more = (x[order[borders[k] : borders[k + 1]]] if (k := int(np.searchsorted(used, bucket))) < len(used) and used[k] == bucket else x[:0] for x, order, used, borders in deals)
        cols["bucket"].append(bucket)
        cols["block_id"].append(block_id)
        for name, x in (("lines", line[mine].astype("<u4")), ("docs", doc[mine]), ("nulls", null[mine].astype(np.uint8)), ("again", line[more].astype("<u4"))):
            cols[name].append(_pack(x))
        cols["key1"].append(key1[mine].tobytes())
        cols["key2"].append(key2[mine].tobytes())
    yield pa.RecordBatch.from_pydict(cols, schema=KEYS)


FIRSTS = "block_id long, lines binary, weights binary, gone binary"


def _firsts(rows: pa.Table) -> pa.Table:
    """One row a block: its lines that stand nowhere before, with 1 + log2 of how many are equal to each, and those that go."""
    rows = rows.sort_by("block_id").to_pydict()
    line, doc, null, again = ([_unpack(x, t) for x in rows[k]] for k, t in (("lines", "<u4"), ("docs", "<i8"), ("nulls", "u1"), ("again", "<u4")))
    key1, key2 = (np.concatenate([np.frombuffer(x, dtype="<u8") for x in rows[k]]) for k in ("key1", "key2"))
    borders = np.cumsum([0] + [len(x) for x in line])
    block = np.repeat(np.arange(len(line)), np.diff(borders))
    order = np.lexsort((np.concatenate(line), block, np.concatenate(doc), np.concatenate(null), key2, key1))
    new = np.concatenate(([True], (key1[order][1:] != key1[order][:-1]) | (key2[order][1:] != key2[order][:-1])))[: len(order)]
    begin = np.flatnonzero(new)
    weight = np.zeros(len(order), dtype=np.uint8)
    weight[order[begin]] = 1 + np.log2(np.diff(np.append(begin, len(order)))).astype(np.uint8)
    out: dict[str, list] = {"block_id": rows["block_id"], "lines": [], "weights": [], "gone": []}
    for k, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
        stays = weight[a:b] > 0
        out["lines"].append(_pack(line[k][stays]))
        out["weights"].append(zip_bytes(weight[a:b][stays]))
        out["gone"].append(_pack(np.concatenate([line[k][~stays], again[k]])))
    return pa.table(out, schema=pa.schema([("block_id", pa.int64()), ("lines", pa.binary()), ("weights", pa.binary()), ("gone", pa.binary())]))


SENT = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("lines", pa.binary()), ("sizes", pa.binary()), ("sims", pa.binary()), ("weights", pa.binary()), ("residues", pa.binary())])
SENT_FORM = "bucket int, base long, lines binary, sizes binary, sims binary, weights binary, residues binary"


#: Lengths are told apart up to this many code points.
LONGEST = 0xFFFF


def code_points(w: K.Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The length of the lines begin:end, in words, when normalised."""
    total = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
    inside = np.concatenate(([0], np.cumsum(total[w.end] - total[w.begin])))
    return inside[end] - inside[begin] + (end - begin) - 1


def _blocks_of_lines(block_id: int, rows: pa.Table, firsts: pa.Table, text_col: str, keys: int, buckets: int, fold_digits: bool) -> pa.Table:
    """One row a bucket: the SimHash blocks of the lines of a block of rows that stand nowhere before."""
    line = np.concatenate([_unpack(x, "<u4") for x in firsts.column("lines").to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64)
    weight = np.concatenate([np.frombuffer(unzip_bytes(x), dtype=np.uint8) for x in firsts.column("weights").to_pylist()] or [np.zeros(0, np.uint8)])
    order = np.argsort(line)
    line, weight = line[order], weight[order]
    whose, sims, found, base = [], [], [], 0
    size = np.zeros(len(line), dtype="<u2")
    for _, w, ends, _, first in lines_of(rows.column(text_col), fold_digits):
        lo, hi = np.searchsorted(line, [base, base + len(ends)])
        at = line[lo:hi] - base
        base += len(ends)
        if lo < hi:
            size[lo:hi] = np.minimum(code_points(w, first[at], first[at + 1]), LONGEST)
            for who, sim, key in sketches(w, first[at], first[at + 1], keys):
                whose.append(lo + who)
                sims.append(sim)
                found.append(key)
    if not found:
        return SENT.empty_table()
    who, sim, key = (np.concatenate(x) for x in (whose, sims, found))
    order, used, borders = deal(key, buckets)
    cols: dict[str, list] = {k: [] for k in SENT.names}
    for k, bucket in enumerate(used.tolist()):
        mine = order[borders[k] : borders[k + 1]]
        cols["bucket"].append(bucket)
        cols["base"].append(line_base(block_id))
        cols["lines"].append(_pack(line[who[mine]].astype("<u4")))
        cols["sizes"].append(_pack(size[who[mine]]))
        cols["sims"].append(sim[mine].astype("<u8").tobytes())
        cols["weights"].append(zip_bytes(weight[who[mine]]))
        cols["residues"].append(((key[mine] // U64(buckets)) & U64(0xFFFFFFFF)).astype("<u4").tobytes())
    return pa.Table.from_pydict(cols, schema=SENT)


def neighbours(code: np.ndarray, lid: np.ndarray, sim: np.ndarray, size: np.ndarray, weight: np.ndarray, distance: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hubs, nearest) of lines with another within `distance` in their run of equal codes; hub: the lid of the weightiest one."""
    return meetings(code, lid, sim, size, weight, distance, percent)[:3]


def meetings(code: np.ndarray, lid: np.ndarray, sim: np.ndarray, size: np.ndarray, weight: np.ndarray, distance: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `neighbours` gives, and (places, borders) of the lines of each run where more pairs are near than those of lines with their hub or nearest one."""
    order = np.lexsort((lid, code))
    code, lid, sim, weight = code[order], lid[order], sim[order], weight[order]
    length = size[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(code)))
    none = np.iinfo(np.int64).max
    # what is least, best: negative weight or bits, then the place, which is in order of lid
    hub, nearest = np.full(len(code), none), np.full(len(code), none)
    heavy = (255 - weight.astype(np.int64)) << 40
    run_of = np.repeat(np.arange(len(begin)), count)
    pairs = np.zeros(len(begin), dtype=np.int64)  # near ones, by run

    def offer(x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> None:
        hub[x] = np.minimum(hub[x], heavy[y] | y)
        nearest[x] = np.minimum(nearest[x], bits.astype(np.int64) << 40 | y)

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.bitwise_count(sim[x] ^ sim[y])
        a, b = length[x], length[y]
        allowed = (100 - percent) * np.maximum(a, b)  # different lines have one edit at least
        return (bits <= distance) & (100 * np.abs(a - b) <= allowed) & (allowed >= 100) & (lid[x] != lid[y]), bits

    small = count <= 64
    step = 1
    while (small & (count > step)).any():
        runs = small & (count > step)
        x = K.ragged(begin[runs], count[runs] - step)
        y = x + step
        yes, bits = near(x, y)
        x, y, bits = x[yes], y[yes], bits[yes]
        offer(x, y, bits)
        offer(y, x, bits)
        np.add.at(pairs, run_of[x], 1)
        step += 1
    for r, b, n in zip(np.flatnonzero(~small).tolist(), begin[~small].tolist(), count[~small].tolist()):
        twice = 0
        for at in range(b, b + n, 256):
            x = np.arange(at, min(at + 256, b + n))[:, None]
            for to in range(b, b + n, 8192):
                y = np.arange(to, min(to + 8192, b + n))[None, :]
                yes, bits = near(x, y)
                twice += int(np.count_nonzero(yes))
                hub[x[:, 0]] = np.minimum(hub[x[:, 0]], np.where(yes, heavy[y] | y, none).min(axis=1))
                nearest[x[:, 0]] = np.minimum(nearest[x[:, 0]], np.where(yes, bits.astype(np.int64) << 40 | y, none).min(axis=1))
        pairs[r] = twice // 2
    found = np.flatnonzero(hub < none)
    place = (1 << 40) - 1
    hubs, nearest = hub[found] & place, nearest[found] & place
    one, two = np.tile(found, 2), np.concatenate([hubs, nearest])
    told = np.unique(np.minimum(one, two) << 32 | np.maximum(one, two)) >> 32
    more = pairs > np.bincount(run_of[told], minlength=len(begin))
    rest = found[more[run_of[found]]]
    borders = np.flatnonzero(np.concatenate(([True], run_of[rest][1:] != run_of[rest][:-1], [True]))) if len(rest) else np.zeros(1, np.int64)
    return order[found], lid[hubs], lid[nearest], order[rest], borders


#: Lines of one run that are compared in one place; a longer run is cut, and each two of its parts meet.
PART = 4096
#: x, y: lines to compare; or lids, sims: lines whose near pairs are to be compared unless they are of one class, all (split 0) or the first `split` ones with the others.
RUN = "x long, y long, lids array<long>, sims array<long>, split int"


def _cells(lid: np.ndarray, sim: np.ndarray, borders: np.ndarray) -> pa.Table:
    """Rows of lids, sims and split for the runs borders[i]:borders[i + 1]."""
    places, sizes, splits = [], [], []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        parts = [np.arange(p, min(p + PART, b)) for p in range(a, b, PART)]
        for i, part in enumerate(parts):
            places += [part, *(x for other in parts[i + 1 :] for x in (part, other))]
            sizes += [len(part), *(len(part) + len(other) for other in parts[i + 1 :])]
            splits += [0, *(len(part) for _ in parts[i + 1 :])]
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())
    columns = [pa.ListArray.from_arrays(offsets, pa.array(x[at].view(np.int64))) for x in (lid, sim)]
    return pa.table({"lids": columns[0], "sims": columns[1], "split": pa.array(splits, pa.int32())})


def _runs(distance: int, percent: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("base").to_pydict()  # ties between lines don't depend on the order of arrival
        lid = np.concatenate([base + _unpack(x, "<u4").astype(np.int64) for base, x in zip(rows["base"], rows["lines"])])
        sim = np.concatenate([np.frombuffer(x, dtype="<u8") for x in rows["sims"]])
        weight = np.concatenate([np.frombuffer(unzip_bytes(x), dtype=np.uint8) for x in rows["weights"]])
        residue = np.concatenate([np.frombuffer(x, dtype="<u4") for x in rows["residues"]])
        size = np.concatenate([_unpack(x, "<u2") for x in rows["sizes"]]).astype(np.int32)
        at, hub, nearest, rest, borders = meetings(residue, lid, sim, size, weight, distance, percent)
        one, two = np.tile(lid[at], 2), np.concatenate([hub, nearest])
        pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
        cells = _cells(lid[rest], sim[rest], borders)
        none = [pa.nulls(len(pairs), c.type) for c in cells.columns]
        told = pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *none], names=["x", "y", *cells.column_names])
        return pa.concat_tables([told, pa.Table.from_arrays([*(pa.nulls(cells.num_rows, pa.int64()) for _ in "xy"), *cells.columns], names=told.column_names)])

    return run


TEXT = "lid long, no_id boolean, doc_id long, line_text string"


def _texts(block_id: int, rows: pa.Table, wanted: pa.Table, id_col: str, text_col: str, fold_digits: bool) -> pa.Table:
    """The normalised text of each wanted line of a block, and the doc_id of its row."""
    want = np.sort(wanted.column("line").to_numpy())
    ids = rows.column(id_col).cast(pa.int64()).combine_chunks()
    data, offsets = K.flat_bytes(rows.column(text_col))
    breaks = np.flatnonzero(data == 0x0A)
    broken = np.searchsorted(breaks, offsets)  # line breaks before each text
    first = np.concatenate(([0], np.cumsum(np.diff(broken) + 1)))  # of each text, among all lines
    owner = np.searchsorted(first, want, side="right") - 1
    # where each wanted line begins: behind the line break before it, or with its text
    breaks = np.append(breaks, len(data))
    nth = want - first[owner]
    before = broken[owner] + nth
    begin = np.where(nth > 0, breaks[np.maximum(before - 1, 0)] + 1, offsets[owner])
    end = np.minimum(breaks[np.minimum(before, len(breaks) - 1)], offsets[owner + 1])
    some = K.binary_array(data[K.ragged(begin, end - begin)], np.concatenate(([0], np.cumsum(end - begin))))
    out: list[bytes] = []
    for _, w, _, _, first_word in lines_of(some, fold_digits):
        packed, at, to = w.packed()
        packed = packed.tobytes()
        out += [packed[at[a] : to[b - 1]] for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist())]
    mine = ids.take(pa.array(owner))
    return pa.table({"lid": line_base(block_id) + want, "no_id": mine.is_null(), "doc_id": mine, "line_text": pa.array(out, pa.binary()).cast(pa.string())})


def _same(x: str, y: str) -> int:
    """How many code points x and y begin with in common."""
    low, high = 0, min(len(x), len(y))
    step = 8
    while low < high:
        to = min(low + step, high)
        if x[low:to] == y[low:to]:
            low, step = to, 2 * step
        else:
            high, step = to - 1, max(1, (to - low) // 2)
    return low


#: Words that are looked ahead for where two texts go on alike.
AHEAD = 12


def _by_words(one: list[str], two: list[str], most: int) -> bool:
    """Whether replaced, inserted and deleted words lead from one to two by `most` edits; where they differ, they go on at the nearest word in common."""
    i = j = edits = 0
    n, m = len(one), len(two)
    while i < n and j < m:
        if one[i] == two[j]:
            i, j = i + 1, j + 1
            continue
        some, other = one[i : i + AHEAD], two[j : j + AHEAD]
        p, q = len(some), len(other)
        best = p + q
        for k, word in enumerate(some):
            if k >= best:
                break
            if word in other and k + (at := other.index(word)) < best:
                p, q = k, at
                best = p + q
        both = min(p, q)
        for a, b in zip(some[:both], other[:both]):
            if a != b:
                edits += max(len(a), len(b))
        for word in some[both:p] or other[both:q]:
            edits += len(word) + 1
        if edits > most:
            return False
        i, j = i + p, j + q
    return edits + sum(len(w) + 1 for w in one[i:] or two[j:]) <= most


def _stripped(x: str, y: str, most: int) -> tuple[bool | None, str, str]:
    """Whether at most `most` edits lead from x to y, if that is plain, else None; and what is left of x and y to tell by.

    What x and y begin and end with in common takes no edits, and to replace all of the rest, or word by word, bounds them from above.
    """
    if abs(len(x) - len(y)) > most:
        return False, x, y
    same = _same(x, y)
    x, y = x[same:][::-1], y[same:][::-1]
    same = _same(x, y)
    x, y = x[same:], y[same:]
    if max(len(x), len(y)) <= most:
        return True, x, y
    one, two = x.split(" "), y.split(" ")
    if len(one) == len(two) and sum(max(len(a), len(b)) for a, b in zip(one, two) if a != b) <= most or _by_words(one, two, most):
        return True, x, y
    return (None if x and y else False), x, y


def within(x: str, y: str, most: int) -> bool:
    """Whether at most `most` inserted, deleted or replaced code points lead from x to y, by the bit-parallel column algorithm, one machine word for 64 code points."""
    plain, x, y = _stripped(x, y, most)
    return _columns(x, y, most) if plain is None else plain


def _columns(x: str, y: str, most: int) -> bool:
    """The last step of `within`. Of each column only places in the band are told that a way of `most` edits can pass: with d code points more in y it leaves
    the diagonals from 0 to -d by (most - d) / 2 at most. Above the band values are taken one larger at each column, below it one larger at each place."""
    if len(x) > len(y):
        x, y = y, x
    below, above = (most - len(y) + len(x)) // 2, (most + len(y) - len(x)) // 2
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | (1 << i)
    lo = hi = up = down = 0
    edits, limit, stride = len(x), most + len(y), max(64, most // 4)
    for a in range(0, len(y), stride):
        gone, old, lo = max(0, a - above) - lo, hi, max(0, a - above)
        hi = min(len(x), a + stride + below)
        every, top = (1 << hi - lo) - 1, 1 << hi - lo - 1
        up, down = up >> gone | (every >> old - lo << old - lo if old > lo else every), down >> gone
        masks = {c: m >> lo & every for c, m in places.items()}
        for c in y[a : a + stride]:
            here = masks.get(c, 0)
            across = (((here & up) + up) ^ up) | here
            more, less = down | (every & ~(across | up)), up & across
            if more & top:
                edits += 1
            elif less & top:
                edits -= 1
            limit -= 1
            if edits > limit:  # each code point of y still to come takes off one at most
                return False
            more, less = (more << 1) | 1, less << 1
            up, down = (less | ~(here | down | more)) & every, more & (here | down) & every
    return edits <= most


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64), np.array([len(t) for t in texts], dtype=np.int64)


def _many_columns(pairs: list[tuple[str, str]], most: np.ndarray, n_words: int) -> np.ndarray:
    """`_columns` of many pairs at once, whose first text is the shorter one and has up to 64 * n_words code points; the band is one for all, in whole words."""
    (xs, x_size), (ys, y_size) = _points([x for x, _ in pairs]), _points([y for _, y in pairs])
    order = np.arange(len(pairs))
    # the code points of each first text are numbered; masks: at which places each one stands
    at = K.ragged(np.zeros(len(pairs), np.int64), x_size)
    kinds, code = np.unique(np.repeat(order, x_size) << 21 | xs, return_inverse=True)
    cell = code.ravel() * n_words + (at >> 6)
    by = np.argsort(cell, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], cell[by][1:] != cell[by][:-1])))
    masks = np.zeros((len(kinds) + 1) * n_words, dtype=U64)
    masks[cell[by][begin]] = np.bitwise_or.reduceat((U64(1) << (at & 63).astype(U64))[by], begin)
    masks = masks.reshape(-1, n_words).T.copy()
    asked = np.repeat(order, y_size) << 21 | ys
    code = np.minimum(np.searchsorted(kinds, asked), len(kinds) - 1)
    code[kinds[code] != asked] = len(kinds)
    y_first = np.cumsum(y_size) - y_size
    up, down = np.full((n_words, len(pairs)), (1 << 64) - 1, dtype=U64), np.zeros((n_words, len(pairs)), dtype=U64)
    edits, last, top = x_size.copy(), (x_size - 1) >> 6, ((x_size - 1) & 63).astype(U64)
    out = np.zeros(len(pairs), dtype=bool)
    one, high = U64(1), U64(63)
    more_y = y_size - x_size
    below, above, ends = int(((most - more_y) // 2).max()), int(((most + more_y) // 2).max()), int(last.min())
    w_hi = 0
    for t in range(int(y_size.max())):
        if not t & 7:  # pairs that are told leave
            left = y_size - t
            yes, no = edits + np.maximum(left, 0) <= most, edits - np.maximum(left, 0) > most
            out[order[yes]] = True
            stay = ~(yes | no)
            if not stay.any():
                return out
            if not stay.all():
                order, y_size, y_first, edits, last, top, most, more_y = (z[stay] for z in (order, y_size, y_first, edits, last, top, most, more_y))
                up, down = up[:, stay], down[:, stay]
                below, above, ends = int(((most - more_y) // 2).max()), int(((most + more_y) // 2).max()), int(last.min())
                if min(n_words, (below + above) / 64 + 1.5) * (1 / len(order) + 0.001) > 2 * WORK:  # few are left
                    out[order] = [_columns(*pairs[i], k) for i, k in zip(order.tolist(), most.tolist())]
                    return out
        live = y_size > t
        here = code[y_first + np.minimum(t, y_size - 1)]
        more_in, less_in = np.ones(len(order), dtype=U64), np.zeros(len(order), dtype=U64)
        w_hi = max(w_hi, min(n_words - 1, t + below >> 6))
        for w in range(max(0, t - above >> 6), w_hi + 1):
            eq, p, m = masks[w][here], up[w], down[w]
            xv = eq | m
            eq = eq | less_in
            across = (((eq & p) + p) ^ p) | eq
            more, less = m | ~(across | p), p & across
            more_out, less_out = more >> high, less >> high
            if w >= ends:
                edits += np.where(live & (last == w), (more >> top & one).astype(np.int64) - (less >> top & one).astype(np.int64), 0)
            if w == w_hi and w_hi < n_words - 1:  # what is below the band follows its last place
                edits += np.where(live & (last > w), more_out.astype(np.int64) - less_out.astype(np.int64), 0)
            more, less = more << one | more_in, less << one | less_in
            up[w], down[w] = less | ~(xv | more), more & xv
            more_in, less_in = more_out, less_out
    out[order] = edits <= most
    return out


#: Code points that bounds of edits read at once, and the counters of bigrams of a text.
READ, COUNTERS = 1 << 20, 1024


def _counted(texts: list[str]) -> np.ndarray:
    """How often each bigram stands in each text, in COUNTERS hashed counters up to 255."""
    out = np.zeros((len(texts), COUNTERS), dtype=np.uint8)
    total = np.cumsum([len(t) for t in texts])
    a = 0
    while a < len(texts):
        b = max(a + 1, min(a + 2048, int(np.searchsorted(total, (total[a - 1] if a else 0) + READ, side="right"))))
        points, size = _points(texts[a:b])
        text = np.repeat(np.arange(b - a) * COUNTERS, size)
        counter = ((points[:-1] * 0x9E3779B1 + points[1:] * 0x85EBCA77) >> 15) & COUNTERS - 1
        cell = (text[:-1] + counter)[text[:-1] == text[1:]]
        out[a:b] = np.minimum(np.bincount(cell, minlength=(b - a) * COUNTERS), 255).reshape(-1, COUNTERS)
        a = b
    return out


def _surely_apart(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Which pairs surely differ in more than `most` edits: an edit changes 2 bigrams of a text at most. Full counters only make fewer pairs sure."""
    places: dict[str, int] = {}
    at = np.array([[places.setdefault(x, len(places)), places.setdefault(y, len(places))] for x, y in pairs], dtype=np.int64).reshape(-1, 2)
    counted = _counted(list(places))
    total = counted.sum(axis=1, dtype=np.int64)
    out = np.zeros(len(pairs), dtype=bool)
    for a in range(0, len(pairs), 512):
        x, y = at[a : a + 512].T
        other = counted[y]
        missing = (np.maximum(counted[x], other) - other).sum(axis=1, dtype=np.int64)  # of x in y
        out[a : a + 512] = np.maximum(missing, missing - total[x] + total[y]) > 2 * most[a : a + 512]
    return out


def _apart(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Which pairs surely differ in more than `most` edits: an edit changes 3 trigrams of a text at most, and more of one text's are missing in the other.

    Trigrams are told apart by their hashes; equal hashes only make fewer pairs sure.
    """
    out = np.zeros(len(pairs), dtype=bool)
    total = np.cumsum([len(x) + len(y) for x, y in pairs])
    a = 0
    while a < len(pairs):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + READ, side="right")))
        points, size = _points([z for pair in pairs[a:b] for z in pair])
        points = points.astype(U64)
        grams = K.mix(points[:-2] | points[1:-1] << U64(21) | points[2:] << U64(42)) >> U64(31)
        text = np.repeat(np.arange(len(size), dtype=U64), size)
        inside = text[:-2] == text[2:]
        text = text[:-2][inside]
        key = np.sort((text >> U64(1)) << U64(34) | grams[inside] << U64(1) | text & U64(1))
        begin = np.flatnonzero(np.concatenate(([True], key[1:] >> U64(1) != key[:-1] >> U64(1)))) if len(key) else np.zeros(0, np.int64)
        more = np.add.reduceat(1 - 2 * (key & U64(1)).astype(np.int64), begin) if len(key) else begin  # of a trigram in the first text
        pair = (key[begin] >> U64(34)).astype(np.int64)
        missing = np.maximum(*(np.bincount(pair, np.maximum(x, 0), b - a) for x in (more, -more)))
        out[a:b] = missing > 3 * most[a:b]
        a = b
    return out


#: Machine words that first texts are filled up to, so that more of them are compared at once.
FILLED = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64])
#: Pairs of texts that are compared at once, and the work of array operations, by word of 64 code points of the band and pair, beyond which one pair at a time is cheaper.
AT_ONCE, WORK = 4096, 0.05


def all_within(pairs: list[tuple[str, str]], percent: int) -> np.ndarray:
    """Which pairs have the edit similarity `percent` / 100."""
    out = np.zeros(len(pairs), dtype=bool)
    asked: list[tuple[int, str, str, int]] = []
    limits = np.array([max(len(x), len(y)) * (100 - percent) // 100 for x, y in pairs], dtype=np.int64)
    for i in np.flatnonzero(~_surely_apart(pairs, limits)).tolist():
        most = int(limits[i])
        plain, x, y = _stripped(*pairs[i], most)
        if plain is None:
            asked.append((i, x, y, most) if len(x) <= len(y) else (i, y, x, most))
        else:
            out[i] = plain
    apart = _apart([(x, y) for _, x, y, _ in asked], np.array([z[3] for z in asked], dtype=np.int64))
    open_: dict[int, list[tuple[int, str, str, int]]] = {}
    for k in np.flatnonzero(~apart).tolist():
        n_words = -(-len(asked[k][1]) // 64)
        open_.setdefault(int(FILLED[np.searchsorted(FILLED, n_words)]) if n_words <= FILLED[-1] else n_words, []).append(asked[k])
    for n_words, some in open_.items():
        some.sort(key=lambda z: len(z[2]))
        for a in range(0, len(some), AT_ONCE):
            part = some[a : a + AT_ONCE]
            if min(n_words, part[-1][3] / 64 + 1.5) * (1 / len(part) + 0.001) > WORK:
                for i, x, y, most in part:
                    out[i] = _columns(x, y, most)
            else:
                out[[z[0] for z in part]] = _many_columns([(x, y) for _, x, y, _ in part], np.array([z[3] for z in part]), n_words)
    return out


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = all_within(list(zip(batch.column("x_text").to_pylist(), batch.column("y_text").to_pylist())), percent)
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))
    K.release()


#: Near pairs of different classes that are held at once.
HELD = 1 << 20


def settle(rows: pa.Table, distance: int, percent: int) -> pa.Table:
    """Links between classes of lines: what the near pairs of cells connect that classes don't. Rows: cell, split, place, lid, sim, grp, line_text."""
    cell, split, place, lid, grp = (rows.column(c).to_numpy() for c in ("cell", "split", "place", "lid", "grp"))
    sim = rows.column("sim").to_numpy().view(U64)
    lines, first, code = np.unique(lid, return_index=True, return_inverse=True)
    code = code.ravel()
    texts = rows.column("line_text").take(pa.array(first)).to_pylist()
    size = np.array([len(t) for t in texts], dtype=np.int64)
    names, root = np.unique(grp, return_inverse=True)  # the class of each row, and the classes that links join
    root, parent = root.ravel()[first], np.arange(len(names))
    links: list[tuple[int, int]] = []
    tried = np.zeros(0, dtype=np.int64)
    held: list[np.ndarray] = []

    def find(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    def flush() -> None:
        nonlocal tried
        todo = np.setdiff1d(np.concatenate(held), tried) if held else tried[:0]
        held.clear()
        tried = np.union1d(tried, todo) if len(tried) < 8 * HELD else tried
        for a in range(0, len(todo), 8 * AT_ONCE):
            x, y = todo[a : a + 8 * AT_ONCE] >> 32, todo[a : a + 8 * AT_ONCE] & 0xFFFFFFFF
            now = parent
            while (now[now] != now).any():
                now = now[now]
            apart = now[root[x]] != now[root[y]]
            x, y = x[apart], y[apart]
            yes = all_within([(texts[i], texts[j]) for i, j in zip(x.tolist(), y.tolist())], percent)
            for i, j in zip(x[yes].tolist(), y[yes].tolist()):
                one, two = find(root[i]), find(root[j])
                if one != two:
                    parent[max(one, two)] = min(one, two)
                    links.append((int(lines[i]), int(lines[j])))

    order = np.lexsort((place, cell))
    begin = np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1])))
    n_held = 0
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
        mine = order[a:b]
        k = int(split[mine[0]])
        left, right = (mine[:k], mine[k:]) if k else (mine, mine)
        for r in range(0, len(left), 256):
            x, y = left[r : r + 256, None], right[None, :]
            p, q = size[code[x]], size[code[y]]
            allowed = (100 - percent) * np.maximum(p, q)
            near = (np.bitwise_count(sim[x] ^ sim[y]) <= distance) & (100 * np.abs(p - q) <= allowed) & (allowed >= 100) & (root[code[x]] != root[code[y]])
            i, j = np.nonzero(near)
            i, j = code[left[r + i]], code[right[j]]
            held.append(np.unique(np.minimum(i, j) << 32 | np.maximum(i, j)))
            n_held += len(held[-1])
            if n_held > HELD:
                flush()
                n_held = 0
    flush()
    out = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.table({"x": pa.array(out.min(axis=1) if len(out) else out[:, 0]), "y": pa.array(out.max(axis=1) if len(out) else out[:, 1])})


def _settled(cells: DataFrame, classes: DataFrame, texts: DataFrame, distance: int, percent: int) -> DataFrame:
    """Links x, y between classes (lid, grp); lines without one are classes of their own."""
    members = cells.select("cell", "split", "part", F.posexplode(F.arrays_zip("lids", "sims")).alias("place", "m")).select("cell", "split", "part", "place", F.col("m.lids").alias("lid"), F.col("m.sims").alias("sim"))
    members = written(members.join(classes, "lid", "left").withColumn("grp", F.coalesce("grp", "lid")), "members")
    mixed = members.groupBy("cell").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("cell")
    full = members.join(mixed, "cell", "left_semi").join(texts.select("lid", "line_text"), "lid")
    return full.groupBy("part").applyInArrow(lambda t: settle(t, distance, percent), "x long, y long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs x, y that have the edit similarity."""
    one = texts.select(F.col("lid").alias("x"), F.col("line_text").alias("x_text"))
    two = texts.select(F.col("lid").alias("y"), F.col("line_text").alias("y_text"))
    longer = F.greatest(F.length("x_text"), F.length("y_text"))
    apart = F.abs(F.length("x_text") - F.length("y_text"))
    full = pairs.join(one, "x").join(two, "y").where(100 * apart.cast("long") <= (100 - percent) * longer)
    return full.select("x", "y", "x_text", "y_text").mapInArrow(lambda b: _close(b, percent), "x long, y long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, keys: int = 12, distance: int = 18, fold_digits: bool = False) -> DataFrame:
    """The rows of `docs` with only the kept lines in their text, and n_lines and n_removed.

    keys: SimHash blocks of a line, and half of those by trigrams. distance: bits that the SimHashes of two lines may differ in to be compared.
    """
    if not 0 < keys <= len(FACTORS) // 2:
        raise ValueError(f"keys must be from 1 to {len(FACTORS) // 2}")
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept])
    packed = blocks(rows, text_col, label="lines")
    n_blocks = packed.count()

    few = max(64, shuffle_width(spark), n_blocks)
    form = "bucket int, block_id long, lines binary, key1 binary, key2 binary, docs binary, nulls binary, again binary"
    sent = over(packed, lambda i, t: _keys(i, t, id_col, text_col, few, fold_digits), form)
    firsts = written(sent.groupBy("bucket").applyInArrow(_firsts, FIRSTS), "firsts")

    buckets = max(64, shuffle_width(spark), 2 * n_blocks)
    sent = with_answers(packed, firsts, lambda i, t, x: _blocks_of_lines(i, t, x, text_col, keys, buckets, fold_digits), SENT_FORM)
    runs = written(sent.groupBy("bucket").applyInArrow(_runs(distance, percent, buckets), RUN), "runs")
    met = written(runs.where("x is not null").select("x", "y").distinct(), "met")
    line = F.explode(F.array("x", "y")).alias("lid")
    wanted = met.select(line).distinct().select(block_of_line(F.col("lid")).alias("block_id"), line_of_lid(F.col("lid")).alias("line"))
    none = pa.table({"lid": pa.array([], pa.int64()), "no_id": pa.array([], pa.bool_()), "doc_id": pa.array([], pa.int64()), "line_text": pa.array([], pa.string())})
    texts = written(with_answers(packed, wanted, lambda i, t, x: _texts(i, t, x, id_col, text_col, fold_digits) if x.num_rows else none, TEXT), "texts")

    links = written(_verified(met, texts, percent), "links")
    linked = written(connected_components(links, "x", "y").select(F.col("node").alias("lid"), F.col("component").alias("grp")), "classes")
    # equal runs are one cell; a cell's place among others is that of its first and last line, so that cells of the same lines meet
    cells = runs.where("lids is not null").dropDuplicates(["lids", "split"]).withColumn("cell", F.monotonically_increasing_id())
    cells = written(cells.withColumn("part", F.pmod(F.xxhash64(F.col("lids")[0], F.element_at("lids", -1)), F.lit(max(8, buckets // 16)))), "cells")
    more = written(_settled(cells, linked, texts, distance, percent), "more")
    if not more.isEmpty():
        grp = linked.select("lid", "grp")
        of = lambda c: F.coalesce(F.col(f"{c}_grp"), F.col(c))
        ends = more.join(grp.toDF("x", "x_grp"), "x", "left").join(grp.toDF("y", "y_grp"), "y", "left").select(of("x").alias("x"), of("y").alias("y"))
        joined = written(connected_components(ends, "x", "y").select(F.col("node").alias("grp"), F.col("component").alias("to")), "joined")
        alone = joined.select(F.col("grp").alias("lid"), "grp").join(grp, "lid", "left_anti")
        linked = grp.unionByName(alone).join(joined, "grp", "left").select("lid", F.coalesce("to", "grp").alias("grp"))
    linked = linked.join(texts.select("lid", "no_id", "doc_id"), "lid")
    linked = written(linked, "linked")
    stay = written(linked.groupBy("grp").agg(F.min(F.struct("no_id", "doc_id", "lid"))["lid"].alias("stay")), "stay")
    lost = linked.join(stay, "grp").where("lid <> stay").select(block_of_line(F.col("lid")).alias("block_id"), line_of_lid(F.col("lid")).alias("line"))
    answers = firsts.select("block_id", F.lit(None).cast("long").alias("line"), "gone").unionByName(lost.select("block_id", "line", F.lit(None).cast("binary").alias("gone")))

    def rebuild(block_id: int, t: pa.Table, answers: pa.Table) -> pa.Table:
        gone = [answers.column("line").drop_null().to_numpy(), *(_unpack(x, "<u4").astype(np.int64) for x in answers.column("gone").drop_null().to_pylist())]
        gone = np.sort(np.concatenate(gone))
        data, offsets = K.flat_bytes(t.column(text_col))
        null = np.asarray(t.column(text_col).combine_chunks().is_null())
        breaks = np.flatnonzero(data == 0x0A)
        total = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
        first = np.concatenate(([0], np.cumsum(total)))
        at = np.searchsorted(gone, first)
        removed = np.diff(at)
        texts = t.column(text_col).combine_chunks()
        changed = np.flatnonzero(removed)
        new = {}
        for i in changed.tolist():
            drop = set((gone[at[i] : at[i + 1]] - first[i]).tolist())
            new[i] = "\n".join(s for k, s in enumerate(texts[i].as_py().split("\n")) if k not in drop)
        if new:
            mask = np.zeros(len(texts), dtype=bool)
            mask[changed] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(list(new.values()), texts.type))
        t = t.set_column(t.column_names.index(text_col), text_col, texts)
        return t.append_column("n_lines", pa.array(np.where(null, 0, total), pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return with_answers(packed, answers, rebuild, f"{fields}, n_lines long, n_removed long")
