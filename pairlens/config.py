"""Parameters of the feature pipeline.

``REFERENCE`` holds the workload settings of the original pipeline;
``TEST`` holds the scaled-down settings the registered queries use on the
generated test tables (see FIXTURES.md).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---- fixed values (must equal the original pipeline's for equal results) ----
# Marker appended after every run of boundary characters.
MARKER = "<|reserved_special_token_1|>"
# Tokens that bound a context window.
SENTENCE_ENDERS = ("<|end_of_text|>", "[PAD]")
# Tokens trimmed from both ends of a context.
CONTEXT_TRIM = ("<|end_of_text|>", " ", "")
# Marker put in front of the activated token of a context.
ACTIVATED = "<ACTIVATED>"
# Prefix that stands for a leading blank in byte-level token strings.
SPACE_PREFIX = "ġ"
PAD_TOKEN = "[PAD]"
# End-of-text token; also pads the fixed-length sequences of the segment step.
EOS = "<|end_of_text|>"
# Request prices per million tokens (input, output); other engines cost 0.
PRICES = (("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6))
# Text of an interpretation result that could not be scored.
PARSE_FAILED = "Failed to parse response."
INVALID_LATENT = "Invalid latent ID."
REQUEST_FAILED = "Error during processing."
# Flip and drop shares of the curation step.
FLIP_SHARES = (0.005, 0.01, 0.025, 0.05)
DROP_SHARES = (0.02, 0.04, 0.06, 0.08, 0.1)
# Chat format of the reward-model tokenizer: one header per message, content
# trimmed, end-of-turn token after it; the begin-of-text token is removed.
BOS = "<|begin_of_text|>"
HEADER_START = "<|start_header_id|>"
HEADER_END = "<|end_header_id|>"
END_OF_TURN = "<|eot_id|>"
# ---- end of fixed values ----


@dataclass(frozen=True)
class Params:
    chunk_words: int = 944          # W = max_length - 80
    max_length: int = 1024          # tokens per fixed-length sequence
    min_tail: int = 5               # chunk start must be < n_words - min_tail
    plain_words: int = 512          # token-grain chunk length
    plain_min_tail: int = 1
    gap: int = 5                    # minimum distance between segment ends
    k: int = 64                     # active features per vector
    latent_size: int = 16384        # L
    contrast_top: int = 256         # features kept by contrast
    safety_top: int = 32            # safety features kept
    sign_top: int = 32              # features split by sign
    score_threshold: int = 5
    contexts_per_class: int = 10
    window: int = 128               # context window (max_length of the context step)
    min_lines: int = 4              # a feature needs more contexts than this
    max_classes: int = 32
    sample_features: int = 300
    eps: float = 1e-6
    seed: int = 42
    engine: str = "gpt-4o"
    vector_width: int = 2048        # d
    rm_max_length: int = 4096       # reward-model tokens, left-truncated

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


REFERENCE = Params()

TEST = Params(
    chunk_words=48, max_length=128, min_tail=5, plain_words=64, plain_min_tail=1,
    gap=5, k=8, latent_size=32, contrast_top=16, safety_top=8, sign_top=32,
    contexts_per_class=10, window=128, min_lines=4, sample_features=300,
    vector_width=64, rm_max_length=64,
)
