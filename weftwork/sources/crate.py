"""Research objects: JSON-LD that describes an output folder, and one that goes into an image store."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from weftwork.sources import ngff

# The vocabulary of bio-imaging terms, and the term for the kind of imaging.
TERMS: dict[str, Any] = {
    "organism_classification": "https://schema.org/taxonomicRange",
    "BioChemEntity": "https://schema.org/BioChemEntity",
    "channel": "https://www.openmicroscopy.org/Schemas/Documentation/Generated/OME-2016-06/ome_xsd.html#Channel",
    "obo": "http://purl.obolibrary.org/obo/",
    "FBcv": "http://ontobee.org/ontology/FBcv/",
    "acquisiton_method": {"@reverse": "https://schema.org/result", "@type": "@id"},
    "biological_entity": "https://schema.org/about",
    "biosample": "http://purl.obolibrary.org/obo/OBI_0002648",
    "preparation_method": "https://www.wikidata.org/wiki/Property:P1537",
    "specimen": "http://purl.obolibrary.org/obo/HSO_0000308",
}
IMAGING = {"@id": "obo:FBbi_00000257"}


def acquisition(identifier: str = "#acquisition-001", properties: dict[str, Any] | None = None) -> dict[str, Any]:
    """An entity that is an image acquisition, whatever other types it is given."""
    known = (properties or {}).get("@type", [])
    kinds = [known] if isinstance(known, str) else list(known)
    kinds += [k for k in ("image_acquisition",) if k not in kinds]
    return {"@id": identifier, **(properties or {}), "@type": kinds if len(kinds) > 1 else kinds[0]}


def _crate(root: dict[str, Any], entities: list[dict[str, Any]]) -> str:
    context: list[Any] = ["https://w3id.org/ro/crate/1.1/context", TERMS]
    about = {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}, "conformsTo": {"@id": "https://w3id.org/ro/crate/1.1"}}
    return json.dumps({"@context": context, "@graph": [about, {"@id": "./", "@type": "Dataset", **root}, *entities]}, indent=1)


def folder(images: list[str], workflow: str | None = None) -> str:
    """The crate of an output folder with images in it, and the settings that made them."""
    parts = [{"@id": f"{image}/", "@type": "Dataset"} for image in images]
    flow = [{"@id": workflow, "@type": ["File", "SoftwareSourceCode", "ComputationalWorkflow"], "name": workflow}] if workflow else []
    held = [{"@id": e["@id"]} for e in parts + flow]
    return _crate({"hasPart": held, **({"mainEntity": {"@id": workflow}} if workflow else {})}, [*parts, *flow, acquisition(properties={"fbbi_id": IMAGING})])


def store(name: str) -> str:
    """The crate inside an image store, a result of its acquisition."""
    own = acquisition(properties={"fbbi_id": IMAGING})
    return _crate({"name": name, "resultOf": {"@id": own["@id"]}}, [own])


def write(spark: SparkSession, path: str, crate: str) -> None:
    ngff.write_metadata(spark, path, crate, "ro-crate-metadata.json")
