"""Span, segmentation, entity and rule operators over DataFrames."""
