"""What a user has open and saw last."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

from lodeseam.sources.state import load_json, save_json


@dataclass
class SessionState:
    """D18; kept as a JSON document."""

    current_file: str | None = None
    cursor_line: int | None = None
    open_files: list[str] = field(default_factory=list)
    last_query: str | None = None
    last_results: list[dict] = field(default_factory=list)
    last_search_id: int | None = None

    @classmethod
    def load(cls, path: str | Path) -> "SessionState":
        data = load_json(path, {})
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__}) if isinstance(data, dict) else cls()

    def save(self, path: str | Path) -> None:
        save_json(path, asdict(self))

    def focus(self, file: str, line: int | None = None) -> None:
        self.current_file, self.cursor_line = file, line
        if file not in self.open_files:
            self.open_files.append(file)

    def close(self, file: str) -> None:
        self.open_files = [f for f in self.open_files if f != file]
        if self.current_file == file:
            self.current_file = self.cursor_line = None

    def remember(self, search_id: int, query: str, results: list[dict]) -> None:
        self.last_search_id, self.last_query, self.last_results = search_id, query, results

    def match_read(self, file: str, line: int) -> int | None:
        """The first of the last results that holds a line that is read."""
        return next((k for k, r in enumerate(self.last_results) if r["file_path"] == file and r["start_line"] <= line <= r["end_line"]), None)


@dataclass
class UserProfile:
    """What the user opens and asks; the batch forms are in operators.feedback."""

    file_access_counts: dict[str, int] = field(default_factory=dict)
    recent_queries: list[str] = field(default_factory=list)
    most_queries: int = 20

    def opened(self, file: str) -> None:
        self.file_access_counts[file] = self.file_access_counts.get(file, 0) + 1

    def asked(self, query: str) -> None:
        if query.strip():
            self.recent_queries = [*(q for q in self.recent_queries if q != query), query][-self.most_queries :]

    def affinities(self) -> dict[str, float]:
        """A6"""
        total = sum(self.file_access_counts.values())
        return {f: n / total for f, n in self.file_access_counts.items()} if total else {}
