"""One archive's entries from all that its bytes say: directory, surviving chains, local headers, embedded archives.

The directory is walked where its end record, or its size, puts it; without one, a surviving chain of
records is taken if it is the only one whose headers lie at one common shift. Records whose header is
elsewhere are led there by a piecewise map of shifts. Unless all that accounts for the whole payload,
the scanned headers are a second source: those that no record explains, and that lie in no claimed
payload, are added. Nothing inside an embedded archive is an entry of this one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from typing import NamedTuple

from . import bytesio as b

#: Bytes of a stretch between payloads that may hide a header, and segments of a map of shifts at most.
GAP, SEGMENTS = 30, 4


class Limits(NamedTuple):
    """Bounds of the walks over one file, whatever its own numbers say; each has a code that is reported where it is reached."""

    records: int = 262_144
    record_bytes: int = 128 << 20
    candidates: int = 262_144
    scan_bytes: int = 2 << 30
    name_bytes: int = 64 << 20
    malformed: int = 4096

    def checked(self) -> Limits:
        """Itself; raises ValueError where a bound would admit nothing."""
        if min(self) < 1:
            raise ValueError("a limit of none admits nothing")
        return self


# Codes of the limits.
LIMIT_CODES = {
    "records": "CENTRAL_DIRECTORY_WALK_LIMIT_REACHED",
    "record_bytes": "CENTRAL_DIRECTORY_BYTE_LIMIT_REACHED",
    "candidates": "LOCAL_HEADER_SCAN_LIMIT_REACHED",
    "scan_bytes": "LOCAL_HEADER_SCAN_BYTE_LIMIT_REACHED",
    "name_bytes": "METADATA_ALLOCATION_LIMIT_REACHED",
    "malformed": "MALFORMED_RECORD_STREAK_LIMIT_REACHED",
}


class Placed(NamedTuple):
    """An entry, the offset of its header (None where it is lost), and whether the directory or the scan told of it."""

    entry: b.ZipEntry
    where: int | None
    source: str


class ZipView(NamedTuple):
    entries: list[Placed]
    declared: int | None
    from_directory: int
    directory: str | None  # how it was found: declared, size, chain
    shift: int | None
    segments: int
    moved: int
    nested: int
    rejected: int
    complete: bool
    limits: tuple[str, ...]


def embedded(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(base, end, directory, end record, records) of archives stored inside: an end record whose directory, count and headers fit one base."""
    out, at = {}, data.find(b"PK\x05\x06")
    first = data.find(b"PK\x03\x04")
    while at >= 0:
        if at + 22 <= len(data):
            count, size, cd = (int.from_bytes(data[at + x : at + y], "little") for x, y in ((10, 12), (12, 16), (16, 20)))
            base, end = at - size - cd, at + 22 + int.from_bytes(data[at + 20 : at + 22], "little")
            # one that reaches from the first header to the last byte is the archive itself, maybe behind a stub
            if base >= 0 and end <= len(data) and base not in out and not (end == len(data) and base <= first):
                chain = b.central_chain(data[: base + cd + size], base + cd) if base + cd < len(data) else []
                if count and len(chain) == count and all((h := b.local_record(data, base + e.offset)) and h.name == e.name for e in chain):
                    out[base] = (base, end, base + cd, at, count)
        at = data.find(b"PK\x05\x06", at + 1)
    return sorted(out.values())


def _inside(held: list[tuple], at: int) -> bool:
    """Whether an offset is in one of the stretches (start, end, ...), which may nest."""
    return any(a <= at < z for a, z, *_ in held[: bisect_right(held, (at, 1 << 62))])


def _walk(data: bytes, at: int, limits: Limits, hit: set[str]) -> list[b.ZipEntry]:
    """Directory records one after another; the declared count is no bound, the limits are."""
    out, start, names = [], at, 0
    while got := b.central_record(data, at):
        names += len(got[0].name)
        over = "records" if len(out) >= limits.records else "record_bytes" if got[1] - start > limits.record_bytes else "name_bytes" if names > limits.name_bytes else None
        if over:
            hit.add(over)
            break
        out.append(got[0])
        at = got[1]
    return out


def _scan(data: bytes, limits: Limits, hit: set[str]) -> list[b.ZipEntry]:
    """Local headers from front to back, bounded."""
    out, names, bad = [], 0, 0
    for found in b.local_headers(data, limits.scan_bytes):
        if found is None:
            bad += 1
            if bad >= limits.malformed:
                hit.add("malformed")
                break
            continue
        bad = 0
        names += len(found.name)
        over = "candidates" if len(out) >= limits.candidates else "name_bytes" if names > limits.name_bytes else None
        if over:
            hit.add(over)
            break
        out.append(found)
    if len(data) > limits.scan_bytes:
        hit.add("scan_bytes")
    return out


def shifts(seen: list[tuple[int, int]], most: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first stored offset, shift) of each run of one shift, from observed (stored, physical) offsets that both rise; none if there are too many."""
    runs: list[tuple[int, int]] = []
    last = -1
    for stored, physical in sorted(dict(sorted(seen, reverse=True)).items()):
        if physical <= last:
            continue
        last = physical
        if not runs or runs[-1][1] != physical - stored:
            runs.append((stored, physical - stored))
    return runs if len(runs) <= most else []


def _payload(data: bytes, p: Placed) -> tuple[int, int] | None:
    """Header and payload of a placed entry, cut at the end of the file."""
    head = b.local_record(data, p.where) if p.where is not None else None
    return (p.where, min(len(data), head.data_offset + p.entry.compressed)) if head else None


def view(data: bytes, limits: Limits = Limits()) -> ZipView:  # noqa: B008
    """All entries of an archive: those of its directory first, then those that only the scan tells of, by offset."""
    limits, hit, held = limits.checked(), set(), embedded(data)
    eocd = b.find_eocd(data)
    declared, how, start, central, shift = None, None, None, [], None
    if eocd is not None:
        declared, size, cd = (int.from_bytes(data[eocd + x : eocd + y], "little") for x, y in ((10, 12), (12, 16), (16, 20)))
        for way, at in (("declared", cd), ("size", eocd - size)):
            if at >= 0 and data[at : at + 4] == b"PK\x01\x02" and not _inside(held, at):
                central = _walk(data, at, limits, hit)
                if central:
                    how, start = way, at
                    break
    scanned: list[b.ZipEntry] | None = None
    if not central:
        scanned = _scan(data, limits, hit)
        at_name: dict[bytes, int] = {}
        for e in scanned:
            at_name.setdefault(e.name, e.offset)
        proven = []
        for chain in b.surviving_chains(data, limits.records):
            if _inside(held, chain[0].record_offset):
                continue
            deltas = {at_name[e.name] - e.offset for e in chain if e.name in at_name}
            # a head that is cut off takes headers with it, never the last one
            if len(deltas) == 1 and chain[-1].name in at_name:
                proven.append((chain, deltas.pop()))
        if len(proven) == 1:
            central, shift = proven[0]
            how, start = "chain", central[0].record_offset
    # each record's header: where the record says, else where its name, method and checksum say, else where the map leads
    placed: list[Placed] = []
    moved = 0
    runs: list[tuple[int, int]] = []
    if central:
        is_there = lambda e, at: at >= 0 and (h := b.local_record(data, at)) is not None and h.name == e.name
        if scanned is None and not all(is_there(e, e.offset) for e in central):
            scanned = _scan(data, limits, hit)
        named: dict[bytes, list[b.ZipEntry]] = {}
        for e in scanned or ():
            if not _inside(held, e.offset):
                named.setdefault(e.name, []).append(e)
        seen = []
        for e in central:
            if is_there(e, e.offset):
                seen.append((e.offset, e.offset))
            elif len(same := [h for h in named.get(e.name, ()) if h.method == e.method and h.crc32 in (0, e.crc32)]) == 1:
                seen.append((e.offset, same[0].offset))
        runs = shifts(seen)
        firsts = [a for a, _ in runs]
        for e in central:
            where = e.offset if is_there(e, e.offset) else None
            if where is None and runs:  # the run that it is in, or, at the edge of an edit, the next one
                k = max(0, bisect_right(firsts, e.offset) - 1)
                where = next((to for _, d in runs[k : k + 2] if is_there(e, to := e.offset + d)), None)
            if where is None and shift is not None and is_there(e, e.offset + shift):
                where = e.offset + shift
            moved += where is not None and where != e.offset
            placed.append(Placed(e, where, "directory"))
    claims = sorted(r for p in placed if (r := _payload(data, p)))
    end, hole = 0, False
    for a, z in claims:
        hole = hole or a - end >= GAP
        end = max(end, z)
    hole = hole or (start if start is not None else len(data)) - end >= GAP
    complete = bool(central) and declared == len(central) and all(p.where is not None for p in placed) and not hole
    rejected = 0
    extra: list[Placed] = []
    if not complete:
        if scanned is None:
            scanned = _scan(data, limits, hit)
        # a lost header's entry claims the stretch from where it should be to the next record
        stored = sorted({e.offset for e in central})
        for p in placed:
            if p.where is None:
                k = bisect_right(stored, p.entry.offset)
                claims.append((p.entry.offset, stored[k] if k < len(stored) else (start if start is not None else len(data))))
        claims.sort()
        tops, top = [], 0
        for _, z in claims:
            top = max(top, z)
            tops.append(top)
        own = {p.where for p in placed}
        reach = 0
        for e in scanned:
            if e.offset in own:
                continue
            k = bisect_left(claims, (e.offset + GAP, 0))
            if _inside(held, e.offset) or k and tops[k - 1] > e.offset or e.offset < reach or start is not None and e.offset >= start:
                rejected += 1
                continue
            extra.append(Placed(e, e.offset, "scan"))
            reach = e.data_offset + e.compressed
    return ZipView(placed + extra, declared, len(placed), how, shift, len(runs), moved, len(held), rejected, complete, tuple(LIMIT_CODES[x] for x in LIMIT_CODES if x in hit))
