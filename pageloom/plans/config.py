"""Settings of the page pipeline; held on the driver and sent with the tasks, never a table."""

from __future__ import annotations

from dataclasses import dataclass

from pageloom import schemas


@dataclass(frozen=True)
class Config:
    # transcription service
    ocr_url: str = "http://localhost:8000/v1"
    ocr_model: str = "page-ocr"
    ocr_key: str = "none"
    ocr_tokens: int = 2048
    ocr_temperature: float = 0.1
    ocr_repetition_penalty: float = 1.15
    # fixed values: the repeated text at which a transcription stops, and the longest side of an image that is sent
    ocr_stop: tuple[str, ...] = ("\\\\\n\\text{O}",)
    longest_side: int = 1288
    rotate_retry: bool = True
    # language model service
    llm_url: str = "http://localhost:8001/v1"
    llm_model: str = "records-llm"
    llm_key: str = "none"
    llm_tokens: int = 3072
    llm_temperature: float = 0.0
    guided_json: bool = True
    # detector
    weights: str | None = None
    device: str = "0"
    least_confidence: float = 0.25
    image_size: int = 1024
    # fixed values: the classes of each role, in order
    scheme_classes: tuple[str, ...] = ("reaction_scheme", "scheme", "reaction")
    structure_classes: tuple[str, ...] = ("chemical_structure", "molecule", "structure")
    # behaviour
    max_retries: int = 4
    recognise_structures: bool = True
    rows_per_batch: int = 16
    run_dir: str | None = None  # where stages are written; without one, the session's shared folder
    run_id: str = "run"

    def roles(self) -> dict[str, list[str]]:
        return {"scheme": list(self.scheme_classes), "structure": list(self.structure_classes)}


@dataclass(frozen=True)
class Prompts:
    """Our own wording. Texts in {braces} are filled from columns."""

    page: str = "Transcribe this page. Begin with front matter between lines of three dashes that gives primary_language, is_rotation_valid, rotation_correction, is_table and is_diagram. Write [illegible] for what can't be read, [structure] for a drawn structure and [scheme] for a reaction scheme. If the page has no text, the body is null."
    scheme: str = "Transcribe the labels, reagents and conditions in this reaction scheme in reading order. Write [structure] for each drawn structure. If there is no text, answer null."
    entities_system: str = "You extract entities from text about experiments. Answer with JSON only."
    entities: str = "List the entities that occur in the text, each with its text as written, a label out of " + ", ".join(schemas.ENTITY_LABELS) + ", and if known a normal form and a structure. Answer as {{\"entities\": [...]}}.\n\nText:\n{text}"
    summary_system: str = "You write a structured summary of one experiment. Answer with JSON only and state nothing that the sources don't say."
    summary: str = "Page:\n{page}\n\nSchemes:\n{schemes}\n\nEntities:\n{entities}\n\nStructures:\n{structures}\n\nGive run_id, title, goal, conditions, procedure, results, materials, conclusions, uncertainties and confidence."


DEFAULT_PROMPTS = Prompts()
