from . import centroids, digest, embed, hierarchy, knn, lof, ranking, relevance

__all__ = ["centroids", "digest", "embed", "hierarchy", "knn", "lof", "ranking", "relevance"]
