"""Spark-first analytics over colour-infrared aerial tiles, labels and detections."""
