"""Multimodal conversation datasets on Spark: normalise, mix, pack, template, evaluate."""
