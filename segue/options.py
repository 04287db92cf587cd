"""Plan parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MergeOptions:
    prefer: str = "incoming"  # incoming | base: who wins conflicts
    cues: str = "merge"  # merge | replace | fill
    grids: str = "fill"  # fill | replace
    metadata: str = "fill"  # fill | replace
    playlists: str = "merge"  # merge | replace | add
    add_tracks: bool = True
    path_rules: tuple[tuple[str, str], ...] = ()  # incoming prefix -> base prefix
    duration_tolerance_s: float = 2.0

    def reversed(self) -> "MergeOptions":
        """The same policy for the opposite direction, so one side wins both ways."""
        return replace(
            self,
            prefer="base" if self.prefer == "incoming" else "incoming",
            path_rules=tuple((new, old) for old, new in self.path_rules),
        )
