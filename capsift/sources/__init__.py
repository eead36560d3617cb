"""Where packages come from: folders, git references, repositories, object stores, archives."""
