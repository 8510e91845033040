"""Losses and normalisation of frames: one aggregate each, over all but batch dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisframe.frame import TensorFrame, align
from axisframe.functions.elementwise import divide
from axisframe.shape import DimFilter, non_batch


def l1_loss(tf: TensorFrame, dim: DimFilter = non_batch) -> TensorFrame:
    """Sum of absolute values."""
    return tf.reduce(lambda c: F.sum(F.abs(c)), dim)


def l2_loss(tf: TensorFrame, dim: DimFilter = non_batch) -> TensorFrame:
    """Half the sum of squares."""
    return tf.reduce(lambda c: 0.5 * F.sum(c * c), dim)


def normalize_to(tf: TensorFrame, source: TensorFrame | float = 1.0, dim: DimFilter = non_batch) -> TensorFrame:
    """The frame scaled so that its sum over ``dim`` is ``source``, or that of the frame ``source``; by a sum of 0 as :func:`divide`."""
    shares = align(tf, tf.sum(dim), divide)
    return shares * (source.sum(dim) if isinstance(source, TensorFrame) else source)
