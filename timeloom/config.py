"""Settings of the engine; plans take them as arguments and never read the environment themselves."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """The defaults that results depend on."""

    chunk_ms: int = 300_000
    overlap_ms: int = 5_000
    min_last_chunk_ms: int = 60_000
    keyframe_every_ms: int = 8_000
    max_keyframes: int = 6
    min_lang_prob: float = 0.5
    subtitled_lang_prob: float = 0.75
    min_logprob: float = -1.2
    min_word_prob: float = 0.35
    same_text_ratio: float = 0.8
    scene_cut: float = 0.5
    scene_min_ms: int = 15_000
    scene_max_ms: int = 180_000
    scene_visuals: int = 12
    tag_weight: float = 0.6
    tag_threshold: float = 0.5
    chapter_ms: int = 600_000
    chapter_quotes: int = 40
    keyword_bonus: float = 0.15
    text_gap_ms: int = 6_000
    text_tail_ms: int = 4_000
    range_lines: int = 40
    around_ms: int = 15_000
    citation_tolerance_ms: int = 5_000
    source_tolerance_ms: int = 2_000
    max_steps: int = 3
    observation_chars: int = 2_000

    @classmethod
    def from_env(cls, prefix: str = "TIMELOOM_") -> Settings:
        out = cls()
        for f in fields(cls):
            if (raw := os.environ.get(prefix + f.name.upper())) is not None:
                out = replace(out, **{f.name: type(getattr(out, f.name))(raw)})
        return out


DEFAULTS = Settings()

#: Tags in order.
TAGS = (
    "dialogue", "action", "fight", "chase", "battle", "romance", "comedy", "sad", "suspense", "horror", "violence", "celebration",
    "religious_ritual", "speech_to_crowd", "travel", "nature_landscape", "dream_or_vision", "death", "betrayal", "reunion",
)
#: Words that a query's keywords leave out.
STOP_WORDS = (
    "the", "and", "for", "with", "when", "what", "where", "who", "does", "did", "are", "was",
    "scene", "scenes", "about", "that", "this", "there", "from", "into", "show", "find", "any",
)
