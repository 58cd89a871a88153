"""Processing: filters, transformations, batch correction, inference, roll-up."""

from .operators.batch import correct_batch_effect
from .operators.filters import add_filter, apply_filter
from .operators.inference import infer_protein
from .operators.normalise import adjust_ptm_by_protein, log2_transform, normalise, normalize, scale_data
from .operators.ptm import to_ptm
from .operators.rollup import to_peptide, to_protein

__all__ = ["add_filter", "adjust_ptm_by_protein", "apply_filter", "correct_batch_effect", "infer_protein", "log2_transform", "normalise", "normalize", "scale_data", "to_peptide", "to_protein", "to_ptm"]
