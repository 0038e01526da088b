"""Job parameters and their normalisation (driver-side scalars, no data)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace
from datetime import date, datetime, timedelta, timezone

JST = timezone(timedelta(hours=9))

# Modes that never count as regular play, thresholds and sizes of the published reports.
EXCLUDED_MODES = ("群雄伝", "鍛練場", "戦祭り")
DECK_FLOOR = 3
CARD_FLOOR = 10
HIGH_RANK = 100
HIGH_WIN_RATE = 0.55
SIMILAR_COST = 5.0
REPORT_LIMIT = 30
MATRIX_LIMIT = 20
MATRIX_FLOOR = 5
MIX_LIMIT = 3
MIX_FLOOR = 20
RECENT_LIMIT = 30
MEMBER_LIMIT = 8
CORE_LIMIT = 5
PAGE_DEFAULT = 80
PAGE_MAX = 500
PAYLOAD_VERSION = 3

# Scope names.
ALL_PLAYERS = "all_players"
ALL_RANKER = "all_ranker"
ALL_VERSIONS = "all_versions"
RANK_SCOPES = ("all", "traveler_down", "knight_down", "knight_up")

# Accepted spellings of a rank scope; anything else means "all".
RANK_SCOPE_SPELLINGS = {
    "all": ("", "all"),
    "traveler_down": ("traveler", "traveler_down", "traveler_below"),
    "knight_down": ("knight_down", "knight_below"),
    "knight_up": ("knight_up", "knight_above"),
}


def high_rank_scope(limit: int = HIGH_RANK) -> str:
    return f"high_ranker_top{limit}"


def rank_scope_name(text: str | None) -> str:
    key = (text or "all").strip().lower().replace("-", "_")
    for scope, spellings in RANK_SCOPE_SPELLINGS.items():
        if key in spellings:
            return scope
    return "all"


def row_type_name(text: str | None, archetypes: bool = True) -> str:
    key = (text or "").strip().lower()
    for name in ("deck", "card", "archetype"):
        if key in (name, name + "s"):
            return name
    return "archetype" if archetypes else "deck"


def page_limit(limit: int | None) -> int:
    if limit is None:
        return PAGE_DEFAULT
    return min(max(int(limit), 1), PAGE_MAX)


@dataclass(frozen=True)
class JobConfig:
    """What a job runs over. Empty ``version`` means every version (analysis only)."""

    version: str = ""
    date_from: str = "0000-00-00"
    date_to: str = "9999-99-99"
    include_solo: bool = False
    excluded_modes: tuple[str, ...] = EXCLUDED_MODES
    deck_floor: int = DECK_FLOOR
    card_floor: int = CARD_FLOOR
    high_rank: int = HIGH_RANK
    similar_cost: float = SIMILAR_COST
    anchor: str = ""

    def validate(self) -> "JobConfig":
        for value in (self.date_from, self.date_to):
            datetime.strptime(value, "%Y-%m-%d")
        if self.date_to < self.date_from:
            raise ValueError("date_to lies before date_from")
        return self

    @property
    def trend_anchor(self) -> str:
        return self.anchor or self.date_to


def effective_config(cfg: JobConfig, today: date | None = None) -> JobConfig:
    """Let an open window reach today (Japan time); it never shrinks."""
    current = (today or datetime.now(JST).date()).isoformat()
    return replace(cfg, date_to=max(cfg.date_from, cfg.date_to, current))


def override_window(cfg: JobConfig, date_from: str = "", date_to: str = "", version_start: str = "") -> JobConfig:
    """Narrow the window on request; it cannot leave the configured one or precede the version start."""
    floor = max(cfg.date_from, version_start)
    start = max((date_from or cfg.date_from).strip(), floor)
    end = min((date_to or cfg.date_to).strip(), cfg.date_to)
    if end < start:
        raise ValueError(f"date_to must not be before {start}")
    return replace(cfg, date_from=start, date_to=end)


def memo_key(scope: str, subject: str, cfg: JobConfig, watermark: int, **request) -> str:
    """Identity of a persisted result: equal requests over equal data share a key."""
    identity = {"payload_version": PAYLOAD_VERSION, "scope": scope, "subject": subject, "watermark": watermark}
    identity.update(asdict(cfg))
    identity.update(request)
    text = json.dumps(identity, ensure_ascii=False, sort_keys=True, default=str)
    return f"lb:{scope}:{hashlib.sha256(text.encode('utf-8')).hexdigest()[:32]}"
