from rowloom.sources.csv import DENSE, LENIENT, load_dense_matrix, load_dense_vector, load_sparse_matrix, load_sparse_vector, load_tensor
from rowloom.sources.sinks import save_matrix, save_vector
from rowloom.sources.smart import discover, exists, load_matrix, load_vector, operation_of, sniff

__all__ = [
    "DENSE", "LENIENT", "discover", "exists", "load_dense_matrix", "load_dense_vector", "load_matrix", "load_sparse_matrix",
    "load_sparse_vector", "load_tensor", "load_vector", "operation_of", "save_matrix", "save_vector", "sniff",
]
