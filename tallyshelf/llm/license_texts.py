"""Public license notices that texts are compared with; a parameter of the scan."""

from __future__ import annotations

# Phrases that count wherever their words stand, and the labels they give.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The licenses' own notices and the sentences by which works refer to them.
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
     files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
     publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
     subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
     substantial portions of the Software."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
     License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to
     in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
     express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
     conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
     disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
     in the documentation and/or other materials provided with the distribution."""),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
     provided that the above copyright notice and this permission notice appear in all copies."""),
    ("zlib", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
     redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim
     that you wrote the original software."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
     compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
     non-commercial, and by any means."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
     with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
     published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
     published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
     as published by the Free Software Foundation"""),
    ("lgpl", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
     License as published by the Free Software Foundation, either version 3 of the License"""),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
]
