"""Chart texts built in code."""


def std_chart(map_id, objects, set_id=None, difficulty="", timing="0,500,4,2,1,60,1,0", mode=0):
    """objects: (x, y, t) circles, or whole lines."""
    lines = [o if isinstance(o, str) else f"{o[0]},{o[1]},{o[2]},1,0" for o in objects]
    return f"""file format v14

[General]
Mode: {mode}

[Metadata]
Title:Song {map_id}
Artist:Somebody
Creator: Someone
Version:Hard
BeatmapID:{map_id}
BeatmapSetID:{map_id // 10 if set_id is None else set_id}

[Difficulty]
HPDrainRate:5
CircleSize:4
OverallDifficulty:7
ApproachRate:9
{difficulty}
// a comment
[TimingPoints]
{timing}

[HitObjects]
""" + "\r\n".join(lines)


def lane_chart(map_id, keys, notes, set_id=0, timing="0,500,4,2,1,60,1,0", mode=3):
    """notes: (lane, start) or (lane, start, end)."""
    rows = []
    for n in notes:
        x = int((n[0] + 0.5) * 512 / keys)
        rows.append(f"{x},192,{n[1]},1,0,0:0:0:0:" if len(n) == 2 else f"{x},192,{n[1]},128,0,{n[2]}:0:0:0:0:")
    return f"[General]\nMode: {mode}\n[Metadata]\nTitle:L{map_id}\nArtist:A\nCreator:C\nVersion:V\nBeatmapID:{map_id}\nBeatmapSetID:{set_id}\n[Difficulty]\nCircleSize:{keys}\nOverallDifficulty:8\n[TimingPoints]\n{timing}\n[HitObjects]\n" + "\n".join(rows)


def stream(keys, step, n=48, start=1000):
    return [(i * 3 % keys if keys == 7 else i % keys, start + i * step) for i in range(n)]
