"""Parameters of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

# File columns, prompt wording, label wording, special ids.
QUESTION_SOURCE = "paraphrased_question"
QUERY_SOURCE = "sparql_wikidata"
PROMPT_HEADER = "Question → SPARQL:"
PROMPT_QUESTION = "\nQuestion: "
PROMPT_QUERY = "\nSPARQL: "
LABEL_PREFIX = "ENTITY_"
UNKNOWN_EID = "ENTITY_UNK"
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256
IGNORE_INDEX = -100


@dataclass(frozen=True)
class Settings:
    """Operator parameters; every default is a fixed value of the data format."""

    context_length: int = 1024
    max_length: int | None = 1024
    pad_id: int = END_OF_TEXT_ID
    ignore_index: int = IGNORE_INDEX
    batch_sizes: dict[str, int] = field(default_factory=lambda: {"train": 8, "val": 4, "test": 4})
    valid_fraction: float = 0.1
    split_seed: int = 42
    max_new_tokens: int = 50
    #: Rows a model or scorer is given at a time.
    rows_per_call: int = 64

    def batch_size(self, split: str) -> int:
        """Rows per batch for a split; an unknown split name is an error."""
        if split not in self.batch_sizes:
            raise NotImplementedError(f"no batch size for split {split!r}")
        return self.batch_sizes[split]
