"""Settings of a run. Defaults are part of the engine's semantics."""

from __future__ import annotations

from dataclasses import asdict, dataclass


# Names and defaults are written to run_info.json and decide results.
@dataclass(frozen=True)
class RunConfig:
    # generation service
    ollama_host: str = "http://localhost:11434"
    model_name: str = "gemma4:12b"
    temperature: float = 0.2
    max_new_tokens: int = 600
    request_timeout_s: int = 240
    variants_per_chunk: int = 1
    # chunks, in tokens
    target_chunk_tokens: int = 600
    chunk_overlap_pct: float = 0.15
    min_chunk_tokens: int = 40
    max_chunk_tokens: int = 1200
    hard_cut_pattern: str = r"\n\s*\n\s*\n"
    # pages
    min_page_text_chars: int = 20
    boilerplate_section_titles: tuple[str, ...] = (
        "references", "bibliography", "index", "acknowledgments", "acknowledgements", "about the author", "table of contents",
    )
    # gate
    max_seq_tokens: int = 2048
    length_ratio_limit: float = 3.0
    min_answer_tokens: int = 12
    strip_meta_questions: bool = True
    # split
    train_ratio: float = 0.8
    val_ratio: float = 0.1
    test_ratio: float = 0.1
    split_seed: int = 42
    # output
    output_dir: str = "output"
    # deliberate fixes of inherited quirks, off by default
    strict_preamble: bool = False

    @property
    def overlap_tokens(self) -> int:
        return int(self.target_chunk_tokens * self.chunk_overlap_pct)

    def check_ratios(self) -> None:
        if self.val_ratio < 0 or self.test_ratio < 0 or self.val_ratio + self.test_ratio > 1:
            raise ValueError("val_ratio and test_ratio must not be negative or sum to more than 1")

    def as_dict(self) -> dict:
        return asdict(self)
