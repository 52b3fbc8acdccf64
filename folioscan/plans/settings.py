"""Settings with their bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields

# The bounds of each setting.
BOUNDS = {
    "chunk_size": (50, 20_000),
    "chunk_overlap": (0, 20_000),
    "top_k": (1, 50),
    "score_threshold": (0.0, 1.0),
    "max_context_chars": (500, 10_000_000),
    "hashing_dim": (64, 65_536),
    "ocr_min_chars": (0, 100_000),
    "max_prompt_chars": (1, 4000),
    "max_turns": (0, 40),
    "max_sources": (0, 100),
    "max_text_chars": (1, 5_000_000),
}


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 700
    chunk_overlap: int = 100
    top_k: int = 5
    score_threshold: float = 0.75
    max_context_chars: int = 12_000
    hashing_dim: int = 1024
    ocr_min_chars: int = 20
    max_prompt_chars: int = 4000
    max_turns: int = 40
    max_sources: int = 100
    max_text_chars: int = 5_000_000

    def __post_init__(self) -> None:
        for f in fields(self):
            low, high = BOUNDS[f.name]
            if not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must be between {low} and {high}")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")


def check_request(prompt: str, *, top_k: int | None = None, score_threshold: float | None = None, sources: list[str] | None = None, history: list[tuple[str, str]] | None = None, settings: Settings = Settings()) -> str:
    """The stripped prompt of a valid request; ValueError otherwise."""
    prompt = prompt.strip()
    if not 1 <= len(prompt) <= settings.max_prompt_chars:
        raise ValueError(f"the prompt must have 1 to {settings.max_prompt_chars} characters")
    for name, value in (("top_k", top_k), ("score_threshold", score_threshold)):
        low, high = BOUNDS[name]
        if value is not None and not low <= value <= high:
            raise ValueError(f"{name} must be between {low} and {high}")
    if sources is not None and len(sources) > settings.max_sources:
        raise ValueError(f"at most {settings.max_sources} sources")
    if history is not None and len(history) > settings.max_turns:
        raise ValueError(f"at most {settings.max_turns} turns")
    for role, content in history or []:
        if role not in ("user", "assistant") or not 1 <= len(content) <= 20_000:
            raise ValueError("a turn is by the user or the assistant and has 1 to 20000 characters")
    return prompt


def check_text(text: str, source_name: str, settings: Settings = Settings()) -> None:
    """ValueError unless the pasted text and its name are valid."""
    if not text.strip() or len(text) > settings.max_text_chars:
        raise ValueError(f"the text must have 1 to {settings.max_text_chars} characters and not be blank")
    if not 1 <= len(source_name) <= 200 or any(c in source_name for c in '<>"|?*\\/') or not source_name.isprintable():
        raise ValueError("the source name is not valid")
