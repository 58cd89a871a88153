"""Analysis: differential tests, correlation, embeddings, precursor purity."""

from .operators.de import run_de
from .operators.multivariate import add_corr as corr
from .operators.multivariate import add_pca as pca
from .operators.multivariate import add_umap as umap
from .sources.mzml import compute_precursor_isolation_purity
from .sources.mzml import purities as compute_precursor_isolation_purity_from_mzml

__all__ = ["compute_precursor_isolation_purity", "compute_precursor_isolation_purity_from_mzml", "corr", "pca", "run_de", "umap"]
