"""Where artifacts lie: the only place that names them."""

from __future__ import annotations

from dataclasses import dataclass

from timeloom.functions.text import VIDEO_ID
from timeloom.schemas import DDL


@dataclass(frozen=True)
class Layout:
    """Paths under one root; tables hold all videos, media lie in a folder a video."""

    root: str

    def table(self, name: str) -> str:
        if name not in DDL:
            raise KeyError(f"no table {name!r}")
        return f"{self.root}/{name}"

    def media(self, video_id: str, name: str) -> str:
        """original, proxy.mp4, audio.wav, subtitles.srt or a folder of frames."""
        import re

        if not re.match(VIDEO_ID, video_id):
            raise ValueError(f"not a video id: {video_id!r}")
        return f"{self.root}/media/{video_id}/{name}"

    def frame(self, video_id: str, ts_ms: int) -> str:
        return self.media(video_id, f"frames/{ts_ms:09d}.jpg")

    def checkpoint(self, stream: str) -> str:
        return f"{self.root}/_streams/{stream}"
