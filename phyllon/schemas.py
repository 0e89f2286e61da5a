"""Schemas of the tables that the operators take."""

from __future__ import annotations

CROP_CONFIG = "crop string, classes array<string>, model_path string, epochs int"
SAMPLES = "sample_id bigint, crop string, path string, label string, class_idx int, features array<double>"
PIXELS = "image_id bigint, y int, x int, r int, g int, b int"
BOXES = "image_id bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double, conf double"
KNOWLEDGE = "ord int, disease string, severity string, description string, causes string, remedies map<string,array<string>>"
SEVERITY = "severity string, severity_label string"
BRIDGE = "disease string, ord int, med_id bigint"
CROP_GROUPS = "label string, crops array<struct<key: string, name: string, diseases: string>>"
CART_EVENTS = "cart_id bigint, seq bigint, action string, med_id bigint, qty int"
VERDICT = (
    "status string, message string, crop string, disease string, confidence double, "
    "top_predictions array<struct<label: string, confidence: double>>, is_healthy boolean"
)
