"""Options of a discovery run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    content_col: str = "Content"
    chunk_size: int = 1_000_000  # lines that are partitioned together; larger than for one machine
    sample_n: int = 10  # lines that a proposer sees
    infer_n: int = 50  # lines that slot regexes are inferred from (at least sample_n)
    repool_passes: int = 2
    template_correction: bool = True
    infer_slot_regexes: bool = True
    singleton_fallback: bool = True
    goodness: float = 0.3  # a partition with a larger share of constant positions is a leaf
    lower_bound: float = 0.25
    file_support: float = 0.0  # partitions with a smaller share of their chunk aren't split further
    partition_support: float = 0.0  # nor those with a smaller share of their parent
    max_words: int = 0  # of a sampled line; 0 is off
    max_concurrent: int = 3  # calls of the proposer at a time
    timeout: float = 60.0  # seconds for one call; 0 is off
    prompt: str = "default"  # of a model that discover is given: a name or a text, see operators.propose
    answers: str | None = None  # a folder that keeps the proposer's answers for later runs
    resume: str | None = None  # a folder of this run alone: a run that was stopped goes on from its last finished wave

    def __post_init__(self) -> None:
        if self.prompt == "simple":  # its slots have no types to infer from
            object.__setattr__(self, "infer_slot_regexes", False)
