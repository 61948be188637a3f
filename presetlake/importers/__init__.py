"""Models from schemas: tables with their keys, Prisma files, and presets from nested selections."""
