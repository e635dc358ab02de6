"""Binary files: shortcuts and jump lists read by offsets, kinds of files by their first bytes, names that deceive."""

from __future__ import annotations

import codecs
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a shortcut begins with, and kinds of drives (fixed values).
SHORTCUT = bytes.fromhex("4c0000000114020000000000c000000000000046")
DRIVES = {0: "알수없음", 1: "루트없음", 2: "이동식", 3: "고정", 4: "네트워크", 5: "CD", 6: "램"}
TRACKER = 0xA0000003
#: First bytes of kinds of files, and the endings that suit a kind (fixed values).
FIRST_BYTES = (
    (b"MZ", "실행 파일(MZ)"), (b"\x7fELF", "실행 파일(ELF)"), (b"\xca\xfe\xba\xbe", "실행 파일(Mach-O)"), (b"PK\x03\x04", "zip 계열(zip·docx·xlsx·jar)"), (b"Rar!", "rar"),
    (b"7z\xbc\xaf\x27\x1c", "7z"), (b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ", "xz"), (b"%PDF", "pdf"), (b"\xd0\xcf\x11\xe0", "옛 office(doc·xls·ppt)"), (b"{\\rtf", "rtf"),
    (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"SQLite format 3", "sqlite 파일"),
)
ENDINGS = {
    "실행 파일(MZ)": (".exe", ".dll", ".sys", ".msi", ".scr", ".ocx"), "실행 파일(ELF)": (".so", ".elf", ".bin", ""), "실행 파일(Mach-O)": (".dylib", ".bin", ""),
    "zip 계열(zip·docx·xlsx·jar)": (".zip", ".docx", ".xlsx", ".pptx", ".jar", ".apk", ".odt", ".ods", ".epub", ".whl"),
    "rar": (".rar",), "7z": (".7z",), "gzip": (".gz", ".tgz", ".tar"), "bzip2": (".bz2",), "xz": (".xz",), "pdf": (".pdf",),
    "옛 office(doc·xls·ppt)": (".doc", ".xls", ".ppt", ".hwp", ".msg"), "rtf": (".rtf",), "png": (".png",), "jpeg": (".jpg", ".jpeg"), "sqlite 파일": (".db", ".sqlite", ".sqlite3"),
}
#: First letters of kinds of texts, with the endings that suit them (fixed values).
FIRST_LETTERS = (
    ("#!", "셔뱅 스크립트", (".sh", ".bash", ".py", ".pl", ".rb", "")), ("<?php", "php", (".php", ".phtml", ".php5")), ("<!doctype html", "html", (".html", ".htm")), ("<html", "html", (".html", ".htm")),
    ("<script", "스크립트", (".html", ".htm", ".js", ".hta")), ("@echo", "배치", (".bat", ".cmd")), ("<?xml", "xml", (".xml", ".xhtml", ".svg", ".rels", ".config", ".plist", ".resx")),
)
TEXT, BINARY, EMPTY = "텍스트", "이진", "빈 파일"
#: Signs that turn or hide letters, and names that a system keeps for devices (fixed values).
HIDING = r"[\x{202a}-\x{202e}\x{2066}-\x{2069}\x{200b}-\x{200f}\x{061c}\x{feff}]"
DEVICES = ("con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10)))
#: So many first bytes tell a file's kind.
HEAD = 4096

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("computer", "serial", "label", "drive", "unc", "path", "tail", "modified")] + [T.StructField("size", T.LongType()), T.StructField("whole", T.BooleanType())])


def files(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """path, content of the files below path whose names fit; a task takes whole files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path).select("path", "content")


def _zero_ended(data: bytes, at: int) -> str:
    if not 0 < at < len(data):
        return ""
    end = data.find(b"\0", at)
    return data[at : end if end >= 0 else len(data)].decode("cp949", "replace")


def _stamp(ticks: int) -> str:
    try:
        return (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%d %H:%M:%S") if ticks else ""
    except OverflowError:
        return ""


class _Cut(Exception):
    """The data ends within a field."""


def _u(data: bytes, at: int, size: int = 4) -> int:
    if at + size > len(data):
        raise _Cut
    return int.from_bytes(data[at : at + size], "little")


def shortcut(data: bytes) -> dict | None:
    """The fields of one shortcut; None if it is none. whole is False where it was cut off: what was read until then stays."""
    if len(data) < 76 or not data.startswith(SHORTCUT):
        return None
    flags = _u(data, 20)
    out = {"modified": _stamp(_u(data, 44, 8)), "size": _u(data, 52), "whole": True}
    try:
        at = 76
        if flags & 1:
            at += 2 + _u(data, at, 2)
        if flags & 2:
            size = _u(data, at)
            _link(data[at : at + size], out)
            at += size
        for bit in (4, 8, 16, 32, 64):
            if flags & bit:
                at += 2 + _u(data, at, 2) * (2 if flags & 128 else 1)
        if at > len(data):
            raise _Cut
        while at + 8 <= len(data) and (size := _u(data, at)) >= 8:
            if at + size > len(data):
                raise _Cut
            if _u(data, at + 4) == TRACKER and size >= 96:
                out["computer"] = data[at + 16 : at + 32].split(b"\0")[0].decode("ascii", "replace")
            at += size
    except _Cut:
        out["whole"] = False
    return out


def _link(info: bytes, out: dict) -> None:
    """The volume, the share and the paths of a shortcut's link."""
    flags, (volume, path, net, tail) = _u(info, 8), (_u(info, 12 + 4 * k) for k in range(4))
    if flags & 1 and volume:
        out["drive"], out["serial"] = DRIVES.get(_u(info, volume + 4), "?"), f"{_u(info, volume + 8):08X}"
        label = _u(info, volume + 12)
        out["label"] = _zero_ended(info, volume + label) if label else ""
        out["path"] = _zero_ended(info, path)
    if flags & 2 and net:
        out["unc"] = _zero_ended(info[net:], _u(info, net + 8))
    out["tail"] = _zero_ended(info, tail) if tail else ""


@F.pandas_udf(T.ArrayType(RECORD))
def _records(content: pd.Series) -> pd.Series:
    names = [f.name for f in RECORD.fields]

    def read(data: bytes | None) -> list[dict]:
        found, at = [], (data or b"").find(SHORTCUT)
        while at >= 0:
            after = data.find(SHORTCUT, at + 20)
            if one := shortcut(data[at : after if after >= 0 else len(data)]):
                found.append({n: one.get(n) for n in names})
            at = after
        return found

    return content.map(read)


def shortcuts(content: DataFrame) -> DataFrame:
    """path and the fields of each shortcut in files (path, content): one in a shortcut, any number in a jump list, found by how they begin.

    Fields: computer, serial, label, drive, unc, path of the target, tail, modified (UTC), size; whole is false for one that was
    cut off, whose fields until then are given. Files that hold none, are empty or null give no row.
    """
    rows = content.select(F.col("path").alias("file"), F.explode(_records("content")).alias("r"))
    return rows.select("file", "r.*")


def usage(records: DataFrame) -> DataFrame:
    """what, name, n: how often computers, shares and volumes occur; paths are not given. Shares with other than ASCII letters are left out."""
    parts = F.filter(F.split(F.coalesce("unc", F.lit("")), r"\\"), lambda p: p != "")
    share = F.when((F.size(parts) >= 2) & ~F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).rlike(r"[^\x{00}-\x{7f}]"), F.concat(F.lit("\\\\"), F.upper(F.get(parts, F.lit(0))), F.lit("\\"), F.upper(F.get(parts, F.lit(1)))))
    volume = F.when(F.coalesce("serial", F.lit("")) != "", F.concat("serial", F.lit("  "), F.coalesce("drive", F.lit("?")), F.lit("  ["), F.coalesce("label", F.lit("")), F.lit("]")))
    said = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    rows = records.select(F.inline(F.array(said("만든 컴퓨터", F.nullif("computer", F.lit(""))), said("공유 폴더", share), said("볼륨", volume))))
    return rows.where("name IS NOT NULL").groupBy("what", "name").agg(F.count("*").alias("n"))


@F.pandas_udf(T.BooleanType())
def _reads_as_text(head: pd.Series) -> pd.Series:
    """Whether bytes are UTF-8 or the Korean code page, if the last letter may be cut."""

    def reads(data: bytes) -> bool:
        for code in ("utf-8", "cp949"):
            try:
                codecs.getincrementaldecoder(code)().decode(data, False)
                return True
            except UnicodeDecodeError:
                continue
        return False

    return head.map(reads, na_action="ignore")


def ending(name: Column) -> Column:
    """The last ending of a file's name in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^.+(\.[^.]*)$", 1))


def sniffed(content: DataFrame) -> DataFrame:
    """path, kind, text_kind, lies, hidden and unsafe of files (path, content).

    kind: by the first bytes, else binary (a zero byte, or no text), text, or empty. text_kind: of a text, by how it begins; else empty.
    lies: its ending suits another kind. hidden: signs in the name that turn or hide letters. unsafe: why a system can't take
    the name (characters, device, end). A null content counts as empty.
    """
    head = F.substring(F.coalesce("content", F.lit(b"")), 1, HEAD)
    kind = F.when(F.octet_length(head) == 0, EMPTY)
    for first, name in FIRST_BYTES:
        kind = kind.when(F.startswith(head, F.lit(first)), name)
    kind = kind.when(F.hex(head).rlike("^(?:[0-9A-F]{2})*?00"), BINARY).otherwise(TEXT)
    rows = content.select("path", head.alias("head"), kind.alias("kind"), ending(F.col("path")).alias("ending"), F.element_at(F.split("path", "/"), -1).alias("name"))
    rows = rows.withColumn("kind", F.when((F.col("kind") == TEXT) & ~_reads_as_text("head"), BINARY).otherwise(F.col("kind")))
    said = F.lower(F.regexp_replace(F.col("head").cast("string"), r"^[\x{feff}\s]+", ""))
    text_kind, suits = F.lit(""), F.lit(None).cast("boolean")
    for first, name, endings in reversed(FIRST_LETTERS):
        hit = (F.col("kind") == TEXT) & F.startswith(said, F.lit(first))
        text_kind, suits = F.when(hit, name).otherwise(text_kind), F.when(hit, F.col("ending").isin(*endings)).otherwise(suits)
    for name, endings in ENDINGS.items():
        suits = F.when(F.col("kind") == name, F.col("ending").isin(*endings)).otherwise(suits)
    bad = F.array_sort(F.array_distinct(F.regexp_extract_all("name", F.lit(r'([<>:"|?*\x00-\x1f])'))))
    stem = F.rtrim(F.lower(F.split("name", r"\.")[0]))
    unsafe = F.array_compact(
        F.array(
            F.when(F.size(bad) > 0, F.concat(F.lit("못 쓰는 문자 "), F.array_join(F.transform(bad, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), " "))),
            F.when(stem.isin(*DEVICES), F.concat(F.lit("예약된 장치 이름 "), F.upper(stem))),
            F.when(F.col("name").rlike(r"[ .]$"), "끝에 공백이나 점"),
        )
    )
    hidden = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("name", F.lit(f"({HIDING})")), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0")))))
    return rows.select("path", "kind", text_kind.alias("text_kind"), (~F.coalesce(suits, F.lit(True))).alias("lies"), hidden.alias("hidden"), unsafe.alias("unsafe"))
