"""Spark-first analytics over places, reviews, dish scores and documents."""

import os

# the driver fits small models with numpy: more threads than two only hinder each other on their small matrices
os.environ.setdefault("OMP_NUM_THREADS", "2")
