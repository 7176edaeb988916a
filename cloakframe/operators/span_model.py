"""A span-classification network as a predictor: words to tensors, logits to disjoint spans.

Labels are given to the network as a prompt before the text's words; for each span of up to ``max_width``
words it answers one logit per label.  Tokenizer and session are given by the caller (a ``tokenizers.Tokenizer``
and an ``onnxruntime.InferenceSession``, or anything with the same calls), so no model files are bundled.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

# Words, the prompt's markers unless the configuration names others, the graph's output and a model folder's files.
WORD = re.compile(r"\w+(?:[-_]\w+)*|\S")
ENTITY_MARK, END_MARK = "<<ENT>>", "<<SEP>>"
LOGITS = "logits"
CONFIG_FILE, TOKENIZER_FILE, GRAPH_FILE = "gliner_config.json", "tokenizer.json", "onnx/model_quint8.onnx"


def prompt_of(labels: list[str], entity_mark: str = ENTITY_MARK, end_mark: str = END_MARK) -> list[str]:
    """Each label after its mark, then the end mark; an empty label is its mark alone."""
    return [part for label in labels for part in (entity_mark, label) if part] + [end_mark]


def first_pieces(word_ids: list[int | None], skip: int) -> np.ndarray:
    """For each sub-token: which word of the text (from 1) it begins, or 0; the first skip words are the prompt's."""
    owner = np.array([-1 if w is None else w for w in word_ids], np.int64)
    begins = np.diff(owner, prepend=-1) != 0
    return np.where(begins & (owner >= skip), owner - skip + 1, 0)


def all_spans(n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first and last word of every span from each word, whether it ends inside the text)."""
    first, more = np.divmod(np.arange(n * width, dtype=np.int64), width)
    spans = np.column_stack([first, first + more])
    return spans, spans[:, 1] < n


def decode(logits: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
    """(first word, last word, label, probability) of disjoint spans, likelier ones first in the choice, by place in the result.

    logits: words x widths x labels.  Ties go to the earlier, shorter span and the earlier label.
    """
    n, width, _ = logits.shape
    p = 1 / (1 + np.exp(-logits.astype(np.float32)))
    inside = np.add.outer(np.arange(n), np.arange(width)) < n
    start, more, label = np.nonzero((p > threshold) & inside[:, :, None])
    chance = p[start, more, label]
    free = np.ones(n, bool)
    chosen = []
    for i in np.argsort(-chance, kind="stable").tolist():
        words = slice(start[i], start[i] + more[i] + 1)
        if free[words].all():
            free[words] = False
            chosen.append((int(start[i]), int(start[i] + more[i]), int(label[i]), float(chance[i])))
    return sorted(chosen)


class SpanModel:
    """A predictor for ``ner.model_spans``: (text, labels, threshold) to (start, end, label, score)."""

    def __init__(self, tokenizer, session, max_width: int, max_words: int, entity_mark: str = ENTITY_MARK, end_mark: str = END_MARK):
        self.tokenizer, self.session, self.max_width, self.max_words = tokenizer, session, max_width, max_words
        self.marks = (entity_mark, end_mark)
        self.inputs = {i.name for i in session.get_inputs()}

    def encode(self, words: list[str], labels: list[str]) -> dict[str, np.ndarray]:
        """The tensors of a batch of one; those that the graph doesn't ask for are left out."""
        prompt = prompt_of(labels, *self.marks)
        read = self.tokenizer.encode(prompt + words, is_pretokenized=True)
        spans, valid = all_spans(len(words), self.max_width)
        tensors = {
            "input_ids": np.array(read.ids, np.int64), "attention_mask": np.array(read.attention_mask, np.int64), "words_mask": first_pieces(read.word_ids, len(prompt)),
            "text_lengths": np.array([len(words)], np.int64), "span_idx": spans, "span_mask": valid,
        }
        return {name: tensor[None] for name, tensor in tensors.items() if name in self.inputs}

    def __call__(self, text: str, labels: list[str], threshold: float) -> list[tuple[int, int, str, float]]:
        labels = [*dict.fromkeys(labels)]
        words = [*WORD.finditer(text)][: self.max_words]
        if not words or not labels:
            return []
        logits = np.asarray(self.session.run([LOGITS], self.encode([m[0] for m in words], labels))[0])[0]
        found = decode(logits[: len(words), :, : len(labels)], threshold)
        return [(words[first].start(), words[last].end(), labels[label], p) for first, last, label, p in found]


def builder(folder: str, threads: int = 1) -> Callable[[], SpanModel]:
    """What ``ner.model_spans`` calls once per worker: a model from a folder that every executor can read."""

    def build() -> SpanModel:
        import onnxruntime
        from tokenizers import Tokenizer

        with open(os.path.join(folder, CONFIG_FILE)) as f:
            config = json.load(f)
        if config.get("span_mode") == "token_level":
            raise ValueError(f"{folder}: a model of tokens, not of spans")
        tokenizer = Tokenizer.from_file(os.path.join(folder, TOKENIZER_FILE))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        session = onnxruntime.InferenceSession(os.path.join(folder, GRAPH_FILE), sess_options=options, providers=["CPUExecutionProvider"])
        return SpanModel(tokenizer, session, int(config["max_width"]), int(config["max_len"]), config.get("ent_token", ENTITY_MARK), config.get("sep_token", END_MARK))

    return build
