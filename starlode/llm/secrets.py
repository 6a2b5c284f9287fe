"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Both models are first-order chains over printable ASCII, trained from labelled samples with additive smoothing. Every token
of 16 or more characters is rated by its mean log-likelihood ratio per character (random over ordinary) and is a secret
above a threshold, which is set on further labelled samples so that RECALL of the random strings among them exceed it.

Defined results: a null or empty text has no spans and is returned as it is by ``redact``. Offsets count code points,
ends are exclusive. Spans are ordered by start, then by kind in the order of KINDS. Repeated rows give repeated rows.
Columns other than doc_id and text are ignored by ``scan``; ``redact`` returns the five columns of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from starlode.llm import common

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Share of unseen random strings that have to be found.
RECALL = 0.99

#: Words that identifiers are made of, in four languages.
WORDS = """account address amount answer array author balance batch block branch buffer build bytes cache calendar channel
client cluster code column commit config connection content context count country create current customer data database
date default delete delivery device discount document domain driver duration email employee encoding error event example
feature field file filter first folder format frame function gateway group handler header height history image index
input instance invoice item join kernel label language last layer length level library limit line link list local
location log manager market member memory message method metric model module month name network node number object
offset option order output owner package page parent part password path payment permission phone pipeline platform
point policy port position price process product profile project protocol provider quality query queue random range
rate record region release report request resource response result role route row sample schedule schema scope score
search segment sender sequence server service session setting shipment signal size source space stage start state status
storage store stream string style supplier support system table tag target task template test text thread ticket time
title token total track transaction type unit update upload user value vendor version video view volume warehouse week
width window worker year zone
acheter adresse ancien autre beaucoup boutique chaussure chemin choix client colis commande compte demande dernier droit
eau echange emploi entreprise envoi essai etat facture famille feuille fichier grand heure jeune jour langue lieu livraison
marche mieux moyen niveau nouveau numero ouverture ouvrier paiement pays prix produit quantite question recherche reseau
semaine service soin statut taux tiroir travail utilisateur valeur veille vendeur ville voiture yeux
abschnitt anschrift arbeit aufgabe auftrag ausgabe bank beleg benutzer bericht bestellung betrag bezeichnung bild brief
datei dienst eingang ergebnis fehler feld firma gebiet geschichte gesellschaft gesundheit gewicht grenze gruppe herkunft
jahr kennwort konto kopf kunde lager leistung lieferung menge mitglied monat nachricht netz ordnung pflicht pfad preis
rechnung sammlung schicht schlange schnitt schrift seite sicherheit stadt stufe tabelle tag teil umsatz verbindung verkauf
vertrag verzeichnis vorgang wert wirtschaft woche zahlung zeichen zeit zeitpunkt ziel zugriff zweck
ahorro alumno archivo ayuda bolsa busqueda caja calle cambio cantidad cargo ciudad clave codigo compra comunidad contrato
cuenta cuerpo deseo destino dinero direccion edad empleo empresa entrega envio estado factura fecha fuente gasto grupo
idioma jefe lugar mensaje mercado mes nivel nombre numero objeto pago pedido persona plazo precio prueba pueblo queja
recurso reloj servicio sitio tarea tarjeta tiempo tienda trabajo usuario valor venta vez viaje""".split()


def labelled_samples(n: int = 8000, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (1) and n identifiers as programmers write them (0), from a seeded generator."""
    rng = np.random.default_rng(seed)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    sets = (digits + "abcdef", digits + lower, digits + lower + lower.upper(), digits + lower.upper(), digits + lower + lower.upper() + "+/", lower, lower.upper(), lower + lower.upper())
    join = ("_".join, "-".join, lambda parts: "".join(x.title() for x in parts), lambda parts: "_".join(parts).upper(), "/".join, "".join)
    out: list[tuple[str, int]] = []
    for i in range(n):
        letters = sets[i % len(sets)]
        out.append(("".join(letters[j] for j in rng.integers(0, len(letters), rng.integers(16, 48))), 1))
        parts = [WORDS[j] for j in rng.integers(0, len(WORDS), rng.integers(2, 6))]
        if rng.random() < 0.4:
            parts.append(str(rng.integers(0, 10 ** int(rng.integers(1, 5)))))
        out.append((join[i % len(join)](parts), 0))
    return out


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratios of first letters and of transitions."""

    first: tuple[float, ...]
    step: tuple[tuple[float, ...], ...]

    def ratio(self, token: str) -> float:
        codes = [min(max(ord(c) - 32, 0), 95) for c in token]
        total = self.first[codes[0]] + sum(self.step[a][b] for a, b in zip(codes, codes[1:], strict=False))
        return total / len(codes)


def train(samples: Iterable[tuple[str, int]], smoothing: float = 0.05) -> Markov:
    """Two chains over 96 letters (all others count as the last); smoothing is the count added to each cell."""
    first, step = np.full((2, 96), smoothing), np.full((2, 96, 96), smoothing)
    for text, label in samples:
        codes = np.clip(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) - 32, 0, 95)
        if len(codes):
            first[label, codes[0]] += 1
            np.add.at(step[label], (codes[:-1], codes[1:]), 1)
    first = np.log(first / first.sum(1, keepdims=True))
    step = np.log(step / step.sum(2, keepdims=True))
    return Markov(tuple((first[1] - first[0]).tolist()), tuple(map(tuple, (step[1] - step[0]).tolist())))


def threshold_for(model: Markov, samples: Iterable[tuple[str, int]], recall: float = RECALL) -> float:
    """The ratio that this share of the random strings among the samples exceed."""
    ratios = sorted(model.ratio(text) for text, label in samples if label == 1)
    return ratios[int(len(ratios) * (1 - recall))] - 1e-9


@dataclass(frozen=True)
class Scanner:
    model: Markov
    threshold: float

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the three fixed patterns, in order."""
        out = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(out)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Tokens that the models find random, unless a base span covers them."""
        out = []
        reach, at = 0, 0  # the furthest end of base spans that begin at or before the token
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            while at < len(base) and base[at][0] <= a:
                reach, at = max(reach, base[at][2]), at + 1
            if b > reach and self.ratio(m[0]) > self.threshold:
                out.append((a, 3, b))
        return out

    def ratio(self, token: str) -> float:
        return self.model.ratio(token)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans."""
        base = self.base(text)
        return base, sorted(base + self.added(text, base))


def default_scanner() -> Scanner:
    model = train(labelled_samples())
    return Scanner(model, threshold_for(model, labelled_samples(2000, seed=8)))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Counts of each kind, the digest of the base spans, and all spans of every whole text."""
    scanner = scanner or default_scanner()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
        digests, texts = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            base, every = scanner.spans(text) if text else ([], [])
            for _, kind, _ in every:
                counts[i, kind] += 1
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            texts.append(joined(every))
        named = {f"n_{k}": pa.array(counts[:, i]) for i, k in enumerate(KINDS)}
        return common.batch_of(doc_id=batch.column("doc_id"), **named, base_sha256=pa.array(digests, pa.string()), spans=pa.array(texts, pa.string()))

    return common.map_slices(docs.select("doc_id", "text"), run, SCANNED)


def mask(text: str, spans: list[tuple[int, int, int]], marker: str) -> str:
    """The text with every maximal run of overlapping spans replaced by one marker."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], marker]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, scanner: Scanner | None = None, marker: str = "[secret]") -> DataFrame:
    """Every document, with its secrets masked and n_chars counted anew where something was masked."""
    scanner = scanner or default_scanner()
    docs = docs.select(*common.DOCUMENT_COLUMNS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
        for i, text in enumerate(texts):
            if text and (every := scanner.spans(text)[1]):
                texts[i] = mask(text, every, marker)
                sizes[i] = len(texts[i])
        columns = {c: batch.column(c) for c in common.DOCUMENT_COLUMNS}
        return common.batch_of(**columns | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())})

    return common.map_slices(docs, run, "doc_id long, text string, lang string, source string, n_chars long")


