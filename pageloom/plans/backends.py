"""Model backends behind small protocols, a client for OpenAI-compatible services, and deterministic fakes for tests."""

from __future__ import annotations

import base64
import io
import json
import time
import urllib.request
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pageloom.plans.config import Config


class OcrBackend(Protocol):
    def read(self, image: bytes, prompt: str, turn: int = 0) -> str: ...


class LlmBackend(Protocol):
    def answer(self, system: str, prompt: str, schema: dict | None) -> str: ...


class DetectorBackend(Protocol):
    def detect(self, image: bytes) -> list[tuple[int, float, list[float], bytes | None]]: ...

    def names(self) -> dict[int, str]: ...


class StructureBackend(Protocol):
    def recognise(self, image: bytes) -> str | None: ...


def with_retries(call: Callable[[], str | None], attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's text ('' for null). Any failure is tried again, after 1, 2, 4, … seconds (20 at most); the wait follows the
    last failure too. No attempts left raises RuntimeError."""
    last: Exception | None = None
    for i in range(attempts):
        try:
            return call() or ""
        except Exception as e:  # noqa: BLE001 - services fail in any way
            last = e
            sleep(min(2**i, 20))
    raise RuntimeError(f"gave up after {attempts} attempts: {last}")


def encode_image(content: bytes, longest: int, turn: int = 0) -> str:
    """Base64 PNG, turned back by turn degrees, made RGB and shrunk (never enlarged) to a longest side. Needs Pillow."""
    from PIL import Image

    image = Image.open(io.BytesIO(content)).convert("RGB")
    if turn:
        image = image.rotate(-turn, expand=True)
    image.thumbnail((longest, longest))
    out = io.BytesIO()
    image.save(out, format="PNG")
    return base64.b64encode(out.getvalue()).decode()


@dataclass
class HttpModels:
    """Transcription and language model services with an OpenAI-compatible chat interface."""

    config: Config

    def _chat(self, url: str, key: str, body: dict) -> str:
        request = urllib.request.Request(f"{url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=600) as reply:  # noqa: S310 - the configured service
            return json.load(reply)["choices"][0]["message"]["content"] or ""

    def read(self, image: bytes, prompt: str, turn: int = 0) -> str:
        c = self.config
        picture = {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{encode_image(image, c.longest_side, turn)}"}}
        body = {"model": c.ocr_model, "temperature": c.ocr_temperature, "max_tokens": c.ocr_tokens, "repetition_penalty": c.ocr_repetition_penalty, "messages": [{"role": "user", "content": [{"type": "text", "text": prompt}, picture]}]}
        if c.ocr_stop:
            body["stop"] = list(c.ocr_stop)
        return with_retries(lambda: self._chat(c.ocr_url, c.ocr_key, body), c.max_retries)

    def answer(self, system: str, prompt: str, schema: dict | None) -> str:
        c = self.config
        body = {"model": c.llm_model, "temperature": c.llm_temperature, "max_tokens": c.llm_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        if schema and c.guided_json:
            body["guided_json"] = schema
        return with_retries(lambda: self._chat(c.llm_url, c.llm_key, body), c.max_retries)


@dataclass
class WeightsDetector:
    """A detector from trained weights; needs the ultralytics package and Pillow. Crops are PNG bytes."""

    config: Config

    def __post_init__(self):
        from ultralytics import YOLO

        self.model = YOLO(self.config.weights)

    def names(self) -> dict[int, str]:
        return dict(self.model.names)

    def detect(self, image: bytes) -> list[tuple[int, float, list[float], bytes | None]]:
        from PIL import Image

        c, picture = self.config, Image.open(io.BytesIO(image)).convert("RGB")
        (result,) = self.model.predict(picture, conf=c.least_confidence, imgsz=c.image_size, device=c.device, verbose=False)
        found = []
        for b in result.boxes:
            corners, out = b.xyxy[0].tolist(), io.BytesIO()
            picture.crop(tuple(map(int, corners))).save(out, format="PNG")
            found.append((int(b.cls), float(b.conf), corners, out.getvalue()))
        return found


class NoStructures:
    """The default: structures are not recognised, every result is null."""

    def recognise(self, image: bytes) -> str | None:
        return None


@dataclass
class FakeOcr:
    """Reads an image's bytes as UTF-8. Fails on contents whose checksum is divisible by fail_every; pages that say TURN are
    reported upside down until they are turned."""

    fail_every: int = 0

    def read(self, image: bytes, prompt: str, turn: int = 0) -> str:
        if self.fail_every and zlib.crc32(image) % self.fail_every == 0:
            raise RuntimeError("fake transcription failure")
        text = image.decode("utf-8", "replace")
        upright = "TURN" not in text or turn != 0
        return f"---\nprimary_language: en\nis_rotation_valid: {str(upright).lower()}\nrotation_correction: {0 if upright else 180}\nis_table: false\nis_diagram: false\n---\n{text}"


@dataclass
class FakeDetector:
    """Boxes from lines 'class_id conf x0 y0 x1 y1 text' of an image's bytes; the text is the crop's content."""

    def names(self) -> dict[int, str]:
        return {0: "chemical_structure", 1: "reaction_scheme"}

    def detect(self, image: bytes) -> list[tuple[int, float, list[float], bytes | None]]:
        found = []
        for line in image.decode("utf-8", "replace").splitlines():
            parts = line.split(maxsplit=6)
            if len(parts) == 7 and parts[0].isdigit():
                found.append((int(parts[0]), float(parts[1]), [float(x) for x in parts[2:6]], parts[6].encode()))
        return found


@dataclass
class FakeLlm:
    """Entities are the words with a digit; the summary repeats the first line. broken makes every answer prose."""

    broken: bool = False

    def answer(self, system: str, prompt: str, schema: dict | None) -> str:
        if self.broken:
            return "I can't answer that."
        text = prompt.split("Text:\n", 1)[-1]
        if "entities" in system:
            words = [w for w in text.split() if any(c.isdigit() for c in w)]
            return "Here it is:\n```json\n" + json.dumps({"entities": [{"text": w, "label": "MEASUREMENT", "source": ""} for w in words]}) + "\n```"
        first = text.split("Page:\n", 1)[-1].strip().splitlines() or [""]
        return json.dumps({"goal": first[0], "confidence": 0.5, "conditions": {"n": 1}})
