"""DataFrame operators: pages, resources, scheduling, verification, export."""
