"""What a run can be told, with checks of the values before anything is read."""

from __future__ import annotations

import codecs
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Options:
    # --- fixed values: the defaults
    max_depth: int = 10
    min_specificity: int = 2
    stoplist: Path | None = None
    lang_map: dict[str, str] = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: ["**/target/**", "**/build/**", "**/generated/**", "**/.git/**"])
    follow_symlinks: bool = False
    max_file_bytes: int = 5_000_000
    max_symbols: int = 100_000
    max_paths: int = 1000
    memory_limit_mb: int | None = None
    resume: bool = False
    output_encoding: str = "utf-8-sig"
    encoding_fallback: tuple[str, ...] = ("cp932", "euc-jp", "latin-1")
    max_rows_per_part: int = 1_048_575
    diagnostics_detail_limit: int = 1000
    fast_encoding: bool = False
    decode_cache_dir: str | None = None
    decode_cache_max_bytes: int | None = None

    #: Names and edges that one MB of the memory limit stands for (a fixed value).
    ITEMS_PER_MB = 74_044

    @property
    def items(self) -> int | None:
        return None if self.memory_limit_mb is None else self.memory_limit_mb * self.ITEMS_PER_MB

    def stop_words(self) -> list[str]:
        """Words of the stop list: a line each, without blank lines and those that start with #."""
        if self.stoplist is None:
            return []
        lines = (line.strip() for line in Path(self.stoplist).read_text("utf-8").splitlines())
        return sorted({line for line in lines if line and not line.startswith("#")})

    def problems(self) -> list[str]:
        """What is wrong with the values; nothing is read or written before this is empty."""
        out = []
        for name, least in (("max_depth", 0), ("min_specificity", 0), ("max_file_bytes", 0), ("max_symbols", 1), ("max_paths", 1), ("max_rows_per_part", 1), ("diagnostics_detail_limit", 0), ("memory_limit_mb", 0), ("decode_cache_max_bytes", 1)):
            value = getattr(self, name)
            if value is not None and value < least:
                out.append(f"--{name.replace('_', '-')} must be {least} or more")
        for name in (self.output_encoding, *self.encoding_fallback):
            try:
                codecs.lookup(name)
            except LookupError:
                out.append(f"unknown encoding {name}")
        if not self.encoding_fallback:
            out.append("--encoding-fallback must name an encoding")
        if self.stoplist is not None and not Path(self.stoplist).is_file():
            out.append(f"no stop list at {self.stoplist}")
        return out


def folder_problems(input_dir: Path, output_dir: Path, source_root: Path) -> list[str]:
    """What is wrong with the folders of a run: results must not land among what they come from."""
    out = [f"{name} is no folder: {path}" for name, path in (("--input", input_dir), ("--source-root", source_root)) if not Path(path).is_dir()]
    for name, path in (("--input", input_dir), ("--source-root", source_root)):
        if Path(output_dir).resolve() == Path(path).resolve():
            out.append(f"--output must not be the folder of {name}")
    return out


def parse_lang_map(text: str) -> dict[str, str]:
    """``.ext=language,...``; extensions get their dot and lower case."""
    out = {}
    for pair in filter(None, (p.strip() for p in text.split(","))):
        ext, sep, language = pair.partition("=")
        if not sep or not ext.strip() or not language.strip():
            raise ValueError(f"not .ext=language: {pair}")
        ext = ext.strip().lower()
        out[ext if ext.startswith(".") else "." + ext] = language.strip()
    return out
