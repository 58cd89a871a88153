"""Samples, features and annotation."""

from .operators.filters import reindex_obs, split_sets, subset
from .operators.inference import representative as select_representative
from .operators.inference import select_repr_protein
from .operators.merge import add_modality, add_quant, merge_studies, with_order
from .sources.fasta import attach_fasta, map_fasta

split_tmt = split_sets

__all__ = ["add_modality", "add_quant", "attach_fasta", "map_fasta", "merge_studies", "reindex_obs", "select_repr_protein", "select_representative", "split_sets", "split_tmt", "subset", "with_order"]
