"""Models: what YAML files say about tables, relations and presets."""
