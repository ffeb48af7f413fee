"""Macro sources of a workbook, read and never run.

``modules`` opens the compound file of a macro project, follows its directory of modules and
decompresses their sources; both formats are published. It is a small helper of the reader,
which calls it for one part of one file at a time.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE = 0xFFFFFFFA  # sector numbers from here on are marks

#: Procedures that spreadsheet programs start by themselves, and words that reach outside the workbook.
AUTO = ("Auto_Open", "AutoOpen", "Auto_Close", "AutoClose", "Workbook_Open", "Workbook_Activate", "Workbook_BeforeClose", "Workbook_BeforeSave", "Worksheet_Activate", "Worksheet_Change", "Worksheet_Calculate")
REACH = ("Shell", "CreateObject", "GetObject", "CallByName", "WScript", "PowerShell", "cmd.exe", "URLDownloadToFile", "XMLHTTP", "ADODB.Stream", "FileSystemObject", "SaveToFile", "FollowHyperlink", "SendKeys", "Environ", "Kill", "RegWrite", "VirtualAlloc", "CreateThread", "ExecuteExcel4Macro", "VBProject")
_WORDS = {w.lower(): w for w in (*AUTO, *REACH)}
_PATTERN = re.compile("|".join(rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])" for w in sorted(_WORDS, key=len, reverse=True)), re.IGNORECASE)
_DECLARE = re.compile(r"^\s*(?:(?:Public|Private)\s+)?Declare\s+(?:PtrSafe\s+)?(?:Function|Sub)\s+(\w+)", re.IGNORECASE | re.MULTILINE)


def words(text: str) -> list[str]:
    """The listed words that stand in a text, in the order of the lists."""
    found = {m.lower() for m in _PATTERN.findall(text)}
    return [w for k, w in _WORDS.items() if k in found]


def marks(source: str) -> list[str]:
    """What a source starts by itself, reaches for, and declares from system libraries; comment lines do not count."""
    code = "\n".join(x for x in source.splitlines() if not re.match(r"\s*('|Rem\b|Attribute\b)", x, re.IGNORECASE))
    return words(code) + [f"Declare {m}" for m in sorted(set(_DECLARE.findall(code)))]


def streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by their path, such as ``VBA/dir``."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, limit, first_mini, _, first_more, n_more = struct.unpack_from("<I4xIIIII", data, 48)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    fat_at, at = list(struct.unpack_from("<109I", data, 76)), first_more
    for _ in range(min(n_more, len(data) // size)):
        *more, at = struct.unpack(f"<{size // 4}I", sector(at))
        fat_at += more
    fat = [x for i in fat_at if i < FREE for x in struct.unpack(f"<{size // 4}I", sector(i))]

    def chain(at: int, table: list[int], read) -> bytes:
        out, seen = [], set()
        while at < FREE and at not in seen:
            seen.add(at)
            out.append(read(at))
            at = table[at]
        return b"".join(out)

    entries = []
    directory = chain(first_dir, fat, sector)
    for at in range(0, len(directory) - 127, 128):
        n, kind, left, right, child, start, length = struct.unpack_from("<HBxIII36xIQ", directory, at + 64)
        entries.append((directory[at : at + max(0, n - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, length & 0xFFFFFFFF))
    mini_fat = chain(first_mini, fat, sector)
    mini_fat = list(struct.unpack(f"<{len(mini_fat) // 4}I", mini_fat))
    mini = chain(entries[0][5], fat, sector) if mini_fat else b""
    out: dict[str, bytes] = {}
    todo, seen = [(entries[0][4], "")], set()
    while todo:
        i, path = todo.pop()
        if i >= len(entries) or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, child, start, length = entries[i]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            body = chain(start, mini_fat, lambda j: mini[j * small : (j + 1) * small]) if length < limit else chain(start, fat, sector)
            out[f"{path}{name}"] = body[:length]
    return out


def decompress(data: bytes) -> bytes:
    """A compressed container of the macro format: chunks of tokens, literal bytes or copies from what came before."""
    if not data or data[0] != 1:
        raise ValueError("not a compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        (head,) = struct.unpack_from("<H", data, at)
        stop, begin = min(len(data), at + 3 + (head & 0x0FFF)), len(out)
        at += 2
        if not head & 0x8000:
            out += data[at : at + 4096]
            at += 4096
            continue
        while at < stop:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= stop:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                (token,) = struct.unpack_from("<H", data, at)
                at += 2
                bits = max(4, (len(out) - begin - 1).bit_length())  # as many as the place in the chunk needs
                offset, length = (token >> (16 - bits)) + 1, (token & (0xFFFF >> bits)) + 3
                if offset > len(out) - begin:
                    raise ValueError("a copy reaches before its chunk")
                for _ in range(length):
                    out.append(out[-offset])
    return bytes(out)


def modules(data: bytes) -> Iterator[tuple[str, str]]:
    """Name and source of every module of a macro project."""
    found = streams(data)
    root = next((p[: -len("dir")] for p in found if p.lower().endswith("vba/dir")), None)
    if root is None:
        raise ValueError("no directory of modules")
    raw, at, name, stream, page = decompress(found[f"{root}dir"]), 0, "", "", "cp1252"
    while at + 6 <= len(raw):
        kind, n = struct.unpack_from("<HI", raw, at)
        body = raw[at + 6 : at + 6 + n]
        at += 6 + n + (2 if kind == 0x0009 else 0)  # the version record is two bytes longer than it says
        if kind == 0x0003:
            page = f"cp{struct.unpack('<H', body)[0]}"
        elif kind == 0x0019:
            name = body.decode(page, "replace")
        elif kind == 0x001A:
            stream = body.decode(page, "replace")
        elif kind == 0x0031:
            packed = found.get(f"{root}{stream}", b"")[struct.unpack("<I", body)[0] :]
            yield name, decompress(packed).decode(page, "replace")
