"""Local tensor models: named inputs with checked shapes, static batches, and decoding of outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from pagemill.functions import images
from pagemill.operators.models import BACKENDS, ModelError

Engine = Callable[[dict[str, np.ndarray]], list[np.ndarray]]


@dataclass(frozen=True)
class Input:
    """An engine's input: a kind, and a shape whose first dimension is the batch; -1 is any size."""

    name: str
    shape: tuple[int, ...]
    kind: str = "image"
    value: tuple[float, ...] = ()


def bound(inputs: list[Input], tensors: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """tensors by the engine's input names; a missing or extra name, another shape or type is an error."""
    names = {i.name for i in inputs}
    if names != set(tensors):
        raise ModelError(f"inputs {sorted(names)} and tensors {sorted(tensors)} differ")
    for i in inputs:
        t = tensors[i.name]
        if t.dtype != np.float32:
            raise ModelError(f"{i.name}: only float32 tensors are supported")
        images.shape_size(list(t.shape))
        if len(t.shape) != len(i.shape) or any(w not in (-1, h) for w, h in zip(i.shape, t.shape, strict=True)):
            raise ModelError(f"{i.name}: shape {t.shape} instead of {i.shape}")
    return tensors


def ctc(logits: np.ndarray, vocabulary: list[str], blank: int = 0) -> str:
    """Text of a [1, T, C] output: the first best class of each step, repeats and blanks taken out."""
    if logits.ndim != 3 or logits.shape[0] != 1 or logits.shape[2] != len(vocabulary):
        raise ModelError("the output doesn't fit the vocabulary")
    best = logits[0].argmax(axis=1)
    return "".join(vocabulary[b] for b, before in zip(best, [-1, *best[:-1]], strict=True) if b not in (blank, before))


def layout_items(rows: np.ndarray, labels: list[str], threshold: float, x_scale: float, y_scale: float) -> list[dict]:
    """Layout items of an [N, 6] output of class, score and corners."""
    if rows.size and (rows.ndim != 2 or rows.shape[1] != 6):
        raise ModelError("the output isn't a list of boxes")
    out = []
    for kind, score, *box in rows.reshape(-1, 6).astype(float):
        if not 0 <= int(kind) < len(labels):
            raise ModelError("class without a label")
        if score >= threshold:
            out.append({"label": labels[int(kind)], "score": score, "coordinate": [box[0] * x_scale, box[1] * y_scale, box[2] * x_scale, box[3] * y_scale]})
    return out


class TensorModel:
    """Preprocess, engine, decode. A batch smaller than the engine's static one is filled up with its last sample."""

    def __init__(self, settings: dict):
        self.engine: Engine = settings["engine"]
        self.inputs = [i if isinstance(i, Input) else Input(**i) for i in settings["inputs"]]
        self.batch, self.prepare, self.vocabulary = settings.get("static_batch", 1), settings.get("preprocess", {}), settings["vocabulary"]
        if self.batch < 1 or any(i.shape[0] not in (-1, self.batch) for i in self.inputs):
            raise ValueError("inputs and static_batch differ")

    def tensors(self, image: bytes) -> dict[str, np.ndarray]:
        (pixels,) = images.decode(image)
        out = {}
        for i in self.inputs:
            if i.kind == "image":
                out[i.name] = images.tensor(pixels, i.shape[3], i.shape[2], **self.prepare)
            elif i.kind == "original_shape":
                out[i.name] = np.array([pixels.shape[:2]], np.float32)
            elif i.kind == "scale_factor":
                first = next(j for j in self.inputs if j.kind == "image")
                out[i.name] = np.array([[first.shape[2] / pixels.shape[0], first.shape[3] / pixels.shape[1]]], np.float32)
            else:
                out[i.name] = np.array([i.value], np.float32)
        return out

    def infer_batch(self, requests: list[tuple[bytes | None, str]]) -> list[str]:
        out = []
        for at in range(0, len(requests), self.batch):
            some = [self.tensors(image) for image, _ in requests[at : at + self.batch]]
            joined = {i.name: images.batched([s[i.name] for s in some], self.batch)[0] for i in self.inputs}
            result = self.engine(bound(self.inputs, joined))[0]
            if result.shape[0] != self.batch:
                raise ModelError("a batch answer of a wrong length")
            out += [ctc(r, self.vocabulary) for r in images.unbatched(result, len(some))]
        return out

    def infer(self, image: bytes | None, prompt: str) -> str:
        return self.infer_batch([(image, prompt)])[0]


BACKENDS.add("tensor", TensorModel)
